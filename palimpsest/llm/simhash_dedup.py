"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so
they share at least six positional bytes. Posting lists for single bytes would grow with the square of
the input (256 values each), so a posting key is four positional bytes: the bytes go two by two into
four groups, at least two of which hold no difference, and each of the six pairs of groups makes a key.
For each pair that shares a key, the shared positional bytes are counted; pairs with six or more are
verified bit by bit. A key with more than ``cap`` fingerprints isn't paired at all: its members agree
on 32 bits, so they are grouped by the other 32 bits with at most one bit flipped. Those within one bit
of the same centre differ by two at most, and any two that differ by two at most share such a centre:
exact, with 33 rows for each member and at most 33 members a group.

Documents with equal fingerprints are one vertex. Empty and null texts have fingerprint zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import components, free_name, materialize

_CHUNK = 1 << 16
#: Byte positions of the four groups; the index has a key for each pair of groups.
_GROUPS = ((0, 1), (2, 3), (4, 5), (6, 7))


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text; bytes.lower() and split() are ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    ones, done = np.zeros(64, dtype=np.int64), 0
    while done < n:
        m = min(_CHUNK, n - done)
        h = np.fromiter((xxhash.xxh64_intdigest(next(grams), seed) for _ in range(m)), dtype="<u8", count=m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += m
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_simhash(df: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, out: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and a signed 64-bit fingerprint of the text column."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    hidden = free_name(df, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash64(t.as_py(), shingle, seed) for t in batch.column(hidden)), dtype=np.uint64, count=batch.num_rows)
            kept = batch.drop_columns([hidden])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fps.view(np.int64))], names=[*kept.schema.names, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return df.select(*keep, F.col(text_col).alias(hidden)).mapInArrow(run, schema)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _word(fp: Column, groups: tuple[int, ...]) -> Column:
    """The bytes of the groups as one long."""
    at = [p for g in groups for p in _GROUPS[g]]
    out = _byte(fp, at[0])
    for k, p in enumerate(at[1:], 1):
        out = out + F.shiftleft(_byte(fp, p), 8 * k)
    return out


def fingerprint_links(fps: DataFrame, radius: int = 2, cap: int = 32, salts: int = 8) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints fps(fp): enough of them, all within radius, to join what radius joins."""
    if radius != 2:
        raise ValueError("the byte index is laid out for radius 2")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    fp = F.col("fp")
    keys = F.array(
        *(
            F.struct(
                F.lit(k).alias("table"),
                _word(fp, p).alias("key"),
                _word(fp, tuple(g for g in range(4) if g not in p)).alias("rest"),
            )
            for k, p in enumerate(pairs)
        )
    )
    postings = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.*").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
    sizes = (
        postings.groupBy("table", "key")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    postings = materialize(postings.join(sizes, ["table", "key", "salt"]).drop("salt"), "postings")
    cold = postings.where(F.col("n") <= cap)
    left = cold.select("table", "key", F.col("fp").alias("a"))
    right = cold.select("table", "key", F.col("fp").alias("b"))
    shared = sum((F.when(_byte(F.col("a"), i) == _byte(F.col("b"), i), 1).otherwise(0) for i in range(8)), F.lit(0))
    near = (
        left.join(right, ["table", "key"])
        .where("a < b")
        .where(shared >= 8 - radius)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    centres = (
        postings.where(F.col("n") > cap)
        .select("table", "key", "fp", F.explode(F.transform(flips, lambda f: F.col("rest").bitwiseXOR(f))).alias("centre"))
        .groupBy("table", "key", "centre")
        .agg(F.array_sort(F.collect_set("fp")).alias("all"))
        .where(F.size("all") > 1)
        .select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("b"))
    )
    return near.union(centres).distinct()


def near_duplicate_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = 32) -> DataFrame:
    """One row per document: id, simhash (signed), component (least id reachable; null only if no id in reach)."""
    docs = materialize(with_simhash(df, text_col, keep=[id_col], out="_fp"), "fingerprints")
    each = docs.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("least"))
    labels = components(fingerprint_links(each.select("fp"), cap=cap))
    member = each.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = member.groupBy("root").agg(F.min("least").alias("_component"))
    linked = member.join(roots, "root").select(F.col("fp").alias("_fp"), "_component")
    return docs.join(linked, "_fp").select(id_col, F.col("_fp").alias("simhash"), F.col("_component").alias("component"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that of the least id (numbers or texts). Rows without an id come after all ids, equal texts among them count as one row."""
    key = free_name(df, "_key")
    late = F.col(id_col).isNull()
    keyed = df.withColumn(key, F.struct(late.alias("late"), F.col(id_col).alias("id"), F.when(late, F.md5(F.coalesce(text_col, F.lit("")))).alias("text")))
    spots = near_duplicate_components(keyed, key, text_col)
    # As one text, since a struct with a null inside equals no other in a join.
    flat = lambda c: F.to_json(F.col(c))
    stay = spots.where(F.to_json(key) == flat("component")).select(flat(key).alias(key)).distinct()
    keyed = keyed.withColumn(key, flat(key))
    kept = keyed.join(stay, key, "left_semi")
    ids = keyed.agg(F.count("*"), F.countDistinct(key)).first()
    return (kept if ids[0] == ids[1] else kept.dropDuplicates([key])).select(*df.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
