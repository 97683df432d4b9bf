"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The driver draws, for every input partition, how many of its rows go to every shard: one multivariate
hypergeometric draw after another, so that the matrix has the exact row sums (partition sizes) and
column sums (shard sizes) and the law of a uniform random permutation. Each partition then permutes
its own list of shard labels, the rows are exchanged once, and each shard permutes what it received.

Law ``rows``: shard sizes differ by one at most. Repeated rows and nulls count like any other row, an
empty table gives no rows, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import materialize

#: numpy draws multivariate hypergeometric counts from populations below this.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw for populations of any size: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u, up, down, pu, pd_ = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if (u := u - pu) <= 0:
                return up
        if down > low:
            pd_ *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if (u := u - pd_) <= 0:
                return down
    return mode


def communication_matrix(partition_sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows for each (partition, shard): row sums are the partition sizes, column sums differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(partition_sizes)
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(partition_sizes), shards), dtype=np.int64)
    for i, n in enumerate(partition_sizes):
        if left.sum() < _NUMPY_LIMIT:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest = int(left.sum())
            for s in range(shards):
                rest -= int(left[s])
                out[i, s] = hypergeometric(rng, int(left[s]), rest, n)
                n -= int(out[i, s])
        left -= out[i]
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 42, rows_per_group: int = 512) -> DataFrame:
    """df's columns with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    The rows are first written to the shared folder, so that the count and the dealing see the same
    partitions, also when executors are lost. The driver holds one count per (partition, shard).
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    # The columns travel as one struct, so that their names can't clash with those used here.
    rows = materialize(df.select((F.struct(*columns) if columns else F.lit(0)).alias("row")), "shard-input")
    placed = rows.withColumn("pid", F.spark_partition_id())
    sizes = {r["pid"]: r["count"] for r in placed.groupBy("pid").count().collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], shards, seed)
    shares = spark.sparkContext.broadcast({p: matrix[i] for i, p in enumerate(order)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, at, rng = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if labels is None:
                pid = batch.column("pid")[0].as_py()
                rng = np.random.default_rng([seed, pid])
                labels = np.repeat(np.arange(shards, dtype=np.int32), shares.value[pid])
                rng.shuffle(labels)
            new = [pa.array(labels[at : at + n]), pa.array(rng.integers(0, 1 << 62, n))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], names=["row", "shard", "mix"])
            at += n

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("mix", T.LongType())])
    dealt = placed.mapInArrow(deal, schema)
    groups = max(1, math.ceil(sum(sizes.values()) / shards / rows_per_group))
    dealt = dealt.withColumn("group", F.pmod("mix", F.lit(groups)))
    before = (
        dealt.groupBy("shard", "group")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("group")) - F.col("count"))
        .drop("count")
    )
    within = F.row_number().over(Window.partitionBy("shard", "group").orderBy("mix"))
    return (
        dealt.withColumn("rank", within)
        .join(before, ["shard", "group"])
        .select(*(F.col("row")[c].alias(c) for c in columns), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def op5_shard_shuffle(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(light, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
