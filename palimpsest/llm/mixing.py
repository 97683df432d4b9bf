"""Mixing sources to target weights: how many copies of each document a mix takes, so that every source gives its share of the words.

Words are counted per document and added up per source. Sources share all words by their weights; no target is above ``most`` times its source's words,
and what that frees goes to the others by weight until none is above. With t words and weights w, the targets are min(most * size, w * level) for the one level at
which they add up to t. The level is found from below: sources that the level would fill count with their cap, and the rest share what is left, which raises the level, until no further
source is filled. Each step is an aggregate over one row per source.

The rate target / size says how often a source is repeated: each document is taken floor(rate) times, and once more if a number from a hash of seed and key is under the rate's fraction.
So equal keys are drawn alike, reruns agree, and a source's taken words have its target as their mean.

Everything is DataFrame expressions. The documents are read once: key, source and size are written to the shared folder, where they stay, since the result reads them. A source with a third of all
documents is added up before the shuffle, and is joined by broadcast, or dealt keys if the sources are too many for that. Null texts have no words and are taken by the draw like others. Null sources are one source, after all others
(an empty name is another one). Null keys draw by their text. A source without words has target 0 and rate 0. Empty tables give no rows; other columns pass through ``mix`` unless they have the names of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, global_rank, lookup_join, materialize

#: Sources are broadcast up to so many bytes of names.
_BROADCAST_BYTES = 8 << 20
_DIGITS = 13


def count_words(text: Column) -> Column:
    """The number of runs of characters other than white space (space, and U+0009 to U+000D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(seed: str, *keys: Column) -> Column:
    """A number from 0 up to 1: the first 52 bits of the MD5 of seed and the first key that isn't null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(*(k.cast("string") for k in keys), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))


def targets(sources: DataFrame, size: str, weight: str, most: int = 3) -> DataFrame:
    """sources (a row each) with ``target``: shares of all words by weight, none above ``most`` times its size."""
    cap, w = F.col(size) * most, F.col(weight)
    total = sources.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    left, weights, filled = total, sources.agg(F.sum(weight)).first()[0] or 1, -1
    while True:
        level = F.lit(float(left)) / F.lit(float(weights))
        full = cap <= w * level
        step = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, w)).alias("weight")).first()
        if step["n"] == filled or not step["weight"]:
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(w * level))
        filled, left, weights = step["n"], total - (step["cap"] or 0), step["weight"]


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """(key, size, source_size, target, copies) of every document. Sources weigh ``weights`` in turn, in the order of their names' code points, null last."""
    sized = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~")).alias("_source"), count_words(F.col(text)).alias("size"), draw(seed, F.col(key), F.col(text)).alias("_draw")
    )  # fmt: skip  # names begin with "=", so that "~" is after all of them
    sized = materialize(sized, "sizes")
    sums = global_rank(sized.groupBy("_source").agg(F.sum("size").alias("source_size")), ["_source"], "_rank")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    goals = targets(sums.withColumn("_weight", turn), "source_size", "_weight", most).select("_source", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    copies = F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("bigint")
    both = lookup_join(sized, goals, "_source", F.octet_length("_source") + 32, _BROADCAST_BYTES)
    return both.select(F.col("_key").alias(key), "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each document as many times as the plan says, with ``copy`` from 1 on. The key must be unique and not null."""
    own = plan(docs, key, **how).where("copies > 0").select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    joined = docs.join(own, docs[key] == own["_key"]).drop("_key")
    return joined.withColumnRenamed("_copy", free_name(docs, "copy"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The level comes from sorted caps here: sources are filled in the order of cap / weight.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source
), steps AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM sums WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(arg_min(rest::DOUBLE / weights::DOUBLE, 3 * source_size / weight) FILTER (3 * source_size > weight * (rest::DOUBLE / weights::DOUBLE)), 0) AS level FROM steps
), goals AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, weight * level) AS target FROM sums, level
), rates AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rates
"""
