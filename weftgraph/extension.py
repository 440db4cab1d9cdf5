"""What users add in Python: providers of candidate types, providers of rules, reports of use.

Providers are asked once for each distinct question, in Python workers over Arrow batches; calls that ask the same share the answer.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.rules import lines_of

log = logging.getLogger(__name__)

#: Kinds of what is known of a call's receiver.
HINT_KINDS = ("NEW", "FACTORY", "FACTORY_KEY", "FACTORY_CONST", "FACTORY_CLASS")


@dataclass(frozen=True)
class Hint:
    kind: str
    value: str

    def __post_init__(self):
        if self.kind not in HINT_KINDS:
            raise ValueError(f"not a kind of hint: {self.kind}")


class TypeCandidateProvider(ABC):
    """Names the types that a call's receiver may have. Workers get a pickled copy, so it holds plain data."""

    def init(self, properties: dict[str, str]) -> None:
        """Called once on the driver, before any question."""

    @abstractmethod
    def candidates(self, decl_type: str, signature: str, hints: list[Hint]) -> list[str]:
        """Types by their full names; none to leave the call to others."""

    @abstractmethod
    def label(self) -> str: ...

    def applies_to_static_bound(self) -> bool:
        return False


class RuleProvider(ABC):
    @abstractmethod
    def lines(self) -> list[str]: ...


class UsageReporter(ABC):
    @abstractmethod
    def report(self, usage: DataFrame) -> None:
        """Called once, at the end, with what was applied."""


def provided_types(sites: DataFrame, providers: list[TypeCandidateProvider], static_bound: bool = False) -> DataFrame:
    """(edge_id, rank, label, type): what providers answer for calls (edge_id, decl_type, sig, hints array of (kind, value)); rank is the
    provider's place. A provider that raises is warned of and skipped for that question, as if it had no answer."""
    asked = [(i, p) for i, p in enumerate(providers) if p.applies_to_static_bound() or not static_bound]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, decl_type, sig, hints in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for rank, p in asked:
                    try:
                        found = p.candidates(decl_type, sig, [Hint(h["kind"], h["value"]) for h in hints or []])
                    except Exception:  # a provider is somebody else's code
                        log.warning("provider %s failed for %s#%s", type(p).__name__, decl_type, sig, exc_info=True)
                        continue
                    out += [(key, rank, p.label(), t) for t in dict.fromkeys(found or [])]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["question", "rank", "label", "type"])

    s = sites.withColumn("question", F.xxhash64("decl_type", "sig", "hints"))
    questions = s.groupBy("question").agg(F.first("decl_type").alias("decl_type"), F.first("sig").alias("sig"), F.first("hints").alias("hints"))
    answers = questions.select("question", "decl_type", "sig", "hints").mapInArrow(run, "question long, rank int, label string, type string")
    return s.select("edge_id", "question").join(answers, "question").select("edge_id", "rank", "label", "type")


def provider_targets(provided: DataFrame, sites: DataFrame, chosen: DataFrame, full: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions edge_id, label, target; unusable rank, type): bodies of the types of the first provider that has any with a body. full:
    (name, type) for simple names that one type has. chosen: (type, callee_type, sig, impl)."""
    p = provided
    if full is not None:
        p = p.join(full.select(F.col("name").alias("type"), F.col("type").alias("whole")), "type", "left").withColumn("type", F.coalesce("whole", "type")).drop("whole")
    asked = p.join(sites.select("edge_id", "decl_type", "sig"), "edge_id")
    hit = asked.join(chosen.select("type", F.col("callee_type").alias("decl_type"), "sig", F.col("impl").alias("target")), ["type", "decl_type", "sig"], "left")
    good = hit.where("target IS NOT NULL")
    first = good.groupBy("edge_id").agg(F.min("rank").alias("rank"))
    return good.join(first, ["edge_id", "rank"]).select("edge_id", "label", "target").distinct(), hit.where("target IS NULL").select("rank", "type").distinct()


def provided_lines(spark: SparkSession, providers: list[RuleProvider], start: int = 0) -> DataFrame:
    """(row, text) of all providers' rules, in their order."""
    return lines_of(spark, [x for p in providers for x in p.lines()], start)
