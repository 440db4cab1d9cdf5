"""Quality rules, in DataFrame functions only: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the
whole corpus.

Features of a text are its word 1-grams, word 2-grams and the character 3-grams that end its words, hashed into BUCKETS. Each bucket
weighs log((t + PRIOR) / (e + PRIOR)): t is its count in trusted texts, e the count expected there from the whole corpus. A text's
score is the mean weight of its features; it is kept from THRESHOLD on. Weights are integers (1/SCALE nats), so sums don't depend on
their order. Counts of the corpus are over all texts; trusted texts are at most TRUSTED labelled ones, by hash of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import SPACE_CHARS

BUCKETS = 1 << 14
TRUSTED = 20_000
PRIOR = 20.0
SCALE = 10_000
THRESHOLD = -0.3

_SPACE = r"'[\\x20\\x09-\\x0D]+'"


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with _hash (a hash of each word), _tail (of each word's end), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.withColumn("_text", text)
    docs = docs.withColumn("_trim", F.trim(F.col("_text"), F.lit(SPACE_CHARS)))
    docs = docs.withColumn("_words", F.expr(f"CASE WHEN _trim = '' THEN cast(array() AS array<string>) ELSE split(_trim, {_SPACE}) END"))
    docs = docs.withColumn("_hash", F.expr("transform(_words, w -> xxhash64(w))")).withColumn("_tail", F.expr("transform(_words, w -> xxhash64(right(w, 3), 3))"))
    docs = docs.withColumn("n_words", F.size("_words").cast("long")).withColumn("_lines", F.expr("filter(split(_text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    docs = docs.withColumn("word_chars", F.char_length(F.translate("_text", SPACE_CHARS, "")).cast("long"))
    docs = docs.withColumn("n_symbols", (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long"))
    docs = docs.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    docs = docs.withColumn("_grams", F.expr("CASE WHEN size(_hash) < 5 THEN cast(array() AS array<long>) ELSE transform(sequence(0, size(_hash) - 5), i -> xxhash64(_hash[i], _hash[i + 1], _hash[i + 2], _hash[i + 3], _hash[i + 4])) END"))
    docs = docs.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN sort_array(transform(_grams, (g, i) -> struct(g, i))) END"))
    docs = docs.withColumn("_again", F.expr("sort_array(transform(filter(_sorted, (x, j) -> get(_sorted, j - 1).g = x.g OR get(_sorted, j + 1).g = x.g), x -> x.i))"))
    covered = F.expr("aggregate(transform(_again, (p, j) -> least(5, coalesce(get(_again, j + 1), p + 5) - p)), 0L, (a, x) -> a + x)")
    docs = docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return docs.drop("_text", "_trim", "_words", "_lines", "_grams", "_sorted", "_again")


def features(buckets: int) -> str:
    """SQL of the hashed features from _hash and _tail."""
    return (
        f"concat(transform(_hash, h -> int(pmod(h, {buckets}))), transform(_tail, h -> int(pmod(h, {buckets}))), "
        f"CASE WHEN size(_hash) < 2 THEN cast(array() AS array<int>) ELSE transform(sequence(0, size(_hash) - 2), i -> int(pmod(xxhash64(_hash[i], _hash[i + 1]), {buckets}))) END)"
    )


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, most: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """One row (weights array<int>): the weight of each bucket. trusted: a table of ids in `id_col`, of which `most` at most count."""
    some = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = text.withColumn("_trim", F.trim(F.col("text"), F.lit(SPACE_CHARS)))
    text = text.withColumn("_words", F.expr(f"CASE WHEN _trim = '' THEN cast(array() AS array<string>) ELSE split(_trim, {_SPACE}) END"))
    text = text.withColumn("_hash", F.expr("transform(_words, w -> xxhash64(w))")).withColumn("_tail", F.expr("transform(_words, w -> xxhash64(right(w, 3), 3))"))
    text = text.join(F.broadcast(some.withColumn("hit", F.lit(1))), "id", "left")
    grams = text.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.expr(features(buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("own"))
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "own"])
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "own"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("own").alias("n_own"))
    weight = f"int(round({SCALE} * ln((x.own + {prior}D) / (CASE WHEN n_raw > 0 THEN double(n_own) / n_raw ELSE 0D END * x.raw + {prior}D))))"
    return listed.select(F.expr(f"transform(c, x -> {weight})").alias("weights"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (1/SCALE nats a feature) and kept.

    base_failed: under 10 words, or over 20 % of the words are in 5-word windows that the text has twice or more. kept: not
    base_failed, and the mean weight of the features is not under `threshold`.

    - A null, empty or blank text has no words: it fails the base rules. Every text is scored whole, however long.
    - Without trusted texts (no rows, or none that `docs` has) all weights are 0 and the base rules decide alone.
    - Null and repeated ids and rows are judged each on its own text. Columns of `docs` that have the names added here or those of
      the steps (_text, _hash and so on) are replaced. No rows give no rows.
    """
    weights = bucket_weights(docs, trusted, id_col, text_col)
    out = base_counts(docs, text_col).withColumn("_features", F.expr(features(BUCKETS))).withColumn("_weights", weights.scalar())
    out = out.withColumn("_sum", F.expr("aggregate(_features, 0L, (a, f) -> a + _weights[f])"))
    out = out.withColumn("score", F.when(F.size("_features") > 0, F.col("_sum") / F.size("_features")).otherwise(F.lit(0.0)))
    # the one-row explode keeps later filters on these columns from being pushed below, where they would be computed anew by element
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    out = out.select(*[c for c in docs.columns if c not in (*names, "base_failed", "kept")], F.explode(F.array(F.struct(*names))).alias("_judged")).select("*", "_judged.*").drop("_judged")
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold * SCALE))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of labelled texts of good quality that are not toxic; an id with labels of both kinds is left out."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and toxic = 0").select("doc_id")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
