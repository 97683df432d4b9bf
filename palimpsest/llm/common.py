"""Helpers that several operators share: shared storage, components, free column names."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []
_calls = threading.local()


def _lists() -> list[list[str]]:
    """Tables written by this thread: one list for each open block of own_tables, after that of the thread itself."""
    if not hasattr(_calls, "lists"):
        _calls.lists = [[]]
    return _calls.lists


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """The tables that this thread writes inside the block, in order. Those not deleted by its end go to the block around it."""
    lists, own = _lists(), []
    lists.append(own)
    try:
        yield own
    finally:
        lists.pop()
        lists[-1].extend(own)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one, but only if everything runs in one machine's memory (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _lists()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> str:
    """The same without reading it back: the table's path, for tables that are read together."""
    materialize(df, name)
    return _lists()[-1][-1]


def note_table(name: str, path: str) -> None:
    """Count a table of the catalog and its folder among those written."""
    _lists()[-1].extend([f"table:{name}", path])


def discard(spark: SparkSession, names: list[str]) -> None:
    """Delete tables that were written. Only for those that no DataFrame still in use reads."""
    for name in list(names):
        if name.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {name.removeprefix('table:')}")
        else:
            there = spark._jvm.org.apache.hadoop.fs.Path(name)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        for tables in _lists():
            if name in tables:
                tables.remove(name)


def only_result(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is the last table that it writes: the others go when it is done."""

    @wraps(f)
    def call(*args, **options) -> DataFrame:
        with own_tables() as own:
            result = f(*args, **options)
            discard(result.sparkSession, own[:-1])
        return result

    return call


def written() -> list[str]:
    """All tables that this thread has written and that are still there; a caller that has stored its results may discard them."""
    return [name for tables in _lists() for name in tables]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't use yet (case ignored)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' places, from 1, in the order of the columns, without bringing all rows into one task.

    Rows are dealt out by ranges, and written with the number of their range, since ranges may be cut elsewhere when they are computed again. Rows are ranked within each range; one row per range carries the count of those before.
    """
    part = free_name(df, "_part")
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(name, inside.cast("bigint")).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("_before")).drop(part, "_before")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, salts: int = 8, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges(a, b): one row (v, root) per vertex, root = its least vertex.

    Each round takes the least label among the neighbours and then jumps to the label's label, so the
    number of rounds grows with the logarithm of a chain's length. Each round's labels are a table in
    the shared folder. The jump joins on labels, of which one may be very common: it is salted.
    """
    both = materialize(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(edges.select("b", "a"))
        .where("src <> dst")
        .distinct(),
        "edges",
    )
    with own_tables() as own:
        labels = materialize(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("root")).withColumnRenamed("src", "v"), "labels")
        for _ in range(max_rounds):
            near = (
                both.join(labels.select(F.col("v").alias("dst"), "root"), "dst")
                .select(F.col("src").alias("v"), "root")
                .union(labels.select("v", "root"))
                .groupBy("v")
                .agg(F.min("root").alias("root"))
            )
            near = materialize(near, "labels")
            moved = (
                near.where("root <> v")
                .select(F.col("v").alias("root"), F.col("root").alias("up"))
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            )
            jumped = (
                near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
                .join(moved, ["root", "salt"], "left")
                .select("v", F.coalesce("up", "root").alias("root"))
            )
            jumped = materialize(jumped, "labels")
            changed = jumped.select("v", F.col("root").alias("new")).join(labels, "v").where("new <> root").limit(1).count()
            labels = jumped
            discard(both.sparkSession, own[:-1])  # the labels before
            if not changed:
                return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight, limit: int, salts: int = 16) -> DataFrame:
    """left joined (left outer) with right, unique by key.

    right is broadcast only if the sum of ``weight`` over its rows is at most ``limit``. Otherwise the join is
    a shuffle in which a common key of left is dealt over ``salts`` partitions.
    """
    if (right.agg(F.sum(weight)).first()[0] or 0) <= limit:
        return left.join(F.broadcast(right), key, "left")
    salt = free_name(left, "_salt")
    dealt = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    every = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [key, salt], "left").drop(salt)
