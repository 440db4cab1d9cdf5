"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies: target / source size. Its fraction is a probability. Units are
taken in pairs; mass (words) moves between the two, at random but without bias, until one probability is 0 or 1. So a chunk of a
source keeps its sum of words but for one unit left open; open units of FAN chunks meet in the next round, and one remains a source.
A source's words miss its target by less than that document's size; large documents are
rounded against many smaller ones at once, so it is a small one where there are any. Chunks and draws follow from ids and the seed alone.
"""

from __future__ import annotations

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import materialise, text_slices, word_spans

CHUNK = 2_000
FAN = 64
#: Equal rows that a task makes of their count.
SPREAD = 100_000
BROADCAST_SOURCES = 100_000
_EDGE = 1e-9


def _sizes(batches):
    for batch in batches:
        counts: list[int] = []
        for _, _, b, off in text_slices(batch.column(2)):
            at = word_spans(b, off)[2]
            counts += (at[1:] - at[:-1]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), batch.column(3)], names=["id", "source", "size", "row"])


def source_targets(sized: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, place, n_docs, source_size, target): the weights in turn by source in code-point order, null last, and their shares of
    all sizes, no target above `most` times its source's size; what is above goes to the others by weight.

    A level x gives every source min(most * size, x * weight); sources in order of size / weight meet their cap first.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("place", F.row_number().over(turn) - 1)
    by = by.withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), F.col("place") % len(weights))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumn("rest", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("rest") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    by = by.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    by = by.withColumn("level", F.min_by("level", F.struct(F.when(F.col("free"), 0).otherwise(1), F.col("cap") / F.col("weight"), "place")).over(every)).withColumn("any_free", F.max("free").over(every))
    target = F.when(F.col("any_free"), F.least("cap", F.col("level") * F.col("weight"))).otherwise(F.col("cap"))
    return by.select("source", "place", "n_docs", "source_size", target.alias("target"))


def pivot(units: list[list], rng: random.Random) -> list | None:
    """Round units [.., size, p], largest first, in place, their p to 0 or 1; the one that stays open is returned.

    A unit much larger than the next one is rounded against all that follow together: each gives or takes the same small share of
    its probability. So what stays open at the end is small.
    """
    rest = [0.0] * (len(units) + 1)  # sizes from here on
    for k in range(len(units) - 1, -1, -1):
        rest[k] = rest[k + 1] + (units[k][-2] if _EDGE <= units[k][-1] <= 1 - _EDGE else 0)
    low = min((u[-1] for u in units if u[-2] > 0 and _EDGE <= u[-1] <= 1 - _EDGE), default=0.5)
    high = max((u[-1] for u in units if u[-2] > 0 and _EDGE <= u[-1] <= 1 - _EDGE), default=0.5)
    held, shift = None, 0.0
    for k, u in enumerate(units):
        if u[-2] <= 0 or u[-1] < _EDGE or u[-1] > 1 - _EDGE:
            u[-1] = float(u[-1] > 0.5)
            continue
        p, part = (held[-1], held[-2] / rest[k]) if held is not None else (0.0, 0.0)
        if held is not None and held[-2] > 2 * u[-2] and low + shift - (1 - p) * part > 0.01 and high + shift + p * part < 0.99:
            held[-1] = float(rng.random() < p)
            shift -= (held[-1] - p) * held[-2] / rest[k]
            held = None
        u[-1] += shift
        if held is None:
            held = u
            continue
        s, p, t, q = held[-2], held[-1], u[-2], u[-1]
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if rng.random() * (up + down) < down:
            p, q = p + up / s, q - up / t
        else:
            p, q = p - down / s, q + down / t
        held[-1], u[-1] = p, q
        still = [x for x in (held, u) if _EDGE <= x[-1] <= 1 - _EDGE]
        for x in (held, u):
            if x not in still:
                x[-1] = float(x[-1] > 0.5)
        held = still[0] if still else None
    return held


_UNIT = "id long, row long, place int, size long, source_size long, target double, whole int, chunk long, p double, open boolean"


def _round(seed: int, level: int, last: bool):
    def run(key: tuple[int, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(null=frame["id"].isna()).sort_values(["size", "null", "id", "p", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True).drop(columns="null")
        units = [[i, s, p] for i, (s, p) in enumerate(zip(frame["size"].tolist(), frame["p"].tolist(), strict=True))]
        rng = random.Random(f"{seed} {level} {key[0]} {key[1]}")
        held = pivot(units, rng)
        frame["open"] = False
        if held is not None and last:
            held[-1] = float(rng.random() < held[-1])
        elif held is not None:
            frame.loc[held[0], "open"] = True
        frame["p"] = [u[-1] for u in units]
        return frame

    return run


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows with `copy`, 0, 1, ... among those that are equal, so that these too are dealt to chunks evenly. They are counted, not
    gathered: a task makes at most SPREAD rows of a count."""
    counted = sized.groupBy("id", "source", "size", "row").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPREAD}"))))
    if (counted.agg(F.max("n")).first()[0] or 0) > SPREAD:
        parts = parts.repartition("id", "size", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * SPREAD) - 1
    return parts.withColumn("copy", F.explode(F.sequence(F.col("part") * SPREAD, last))).drop("n", "part")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """(id_col, size, source_size, target, copies): how often the mix takes each row of `docs`. With `row_col`, a number without nulls
    that tells rows of one id apart, that column too.

    Size is the number of words (runs of other than ASCII white space). See source_targets for targets. Copies of a source's rows
    are floor or ceiling of target / source_size, and its taken words are within one (small) document of the target.

    - A null text has size 0; rows of size 0 have no copies beyond the whole ones of their source. A null source is one of its own.
    - Null and repeated ids and rows are units of their own; ties in size go by id. Sources of size 0 have target 0, no copies.
    - Other columns don't matter. No rows give no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"))
    sized = materialise(src.mapInArrow(_sizes, "id long, source string, size long, row long"), "sizes")
    targets = materialise(source_targets(sized, list(weights), most), "targets")
    found = targets.agg(F.count("*"), F.max("n_docs")).first()
    side = targets.withColumnRenamed("source", "of")
    units = _numbered(sized).join(F.broadcast(side) if found[0] <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
    units = units.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "row", "copy"), F.ceil(F.col("n_docs") / CHUNK))).withColumn("open", F.lit(True))
    names = [x.split()[0] for x in _UNIT.split(", ")]
    units, parts, level, chunks = units.select(names), [], 0, -(-(found[1] or 1) // CHUNK)
    while True:
        done = materialise(units.groupBy("place", "chunk").applyInPandas(_round(seed, level, chunks <= 1), _UNIT), "rounded")
        parts.append(done.where("not open"))
        if chunks <= 1:
            break
        units, level, chunks = done.where("open").withColumn("chunk", F.col("chunk").cast("long") - F.col("chunk") % FAN).withColumn("chunk", (F.col("chunk") / FAN).cast("long")), level + 1, -(-chunks // FAN)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), *([F.col("row").alias(row_col)] if row_col else []), "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def op8_mix(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
