"""Reading and writing observation logs and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from palimpsest.functions.text import slug
from palimpsest.sources.schemas import OBSERVATION

#: Columns of the order of observations, captured once at ingest and stored with the row.
ORDER = ("fecha_scraping", "aviso_id", "file", "block", "seq")


def parse_lines(lines: DataFrame, value: str = "value", schema: T.StructType = OBSERVATION) -> DataFrame:
    """JSON lines with the columns of the schema; unreadable lines keep their text in _corrupt. A generator parses them, since filters on columns would be pushed below a projection and parse each line again."""
    parsed = F.from_json(F.col(value), T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in lines.columns if c != value]
    return lines.where(F.trim(value) != "").select(*rest, F.inline_outer(F.array(parsed)))


def read_raw(spark: SparkSession, path: str, schema: T.StructType = OBSERVATION) -> DataFrame:
    """Observations with ``ord``, a struct that orders them by date, id, file and line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return with_order(parse_lines(lines, schema=schema))


def with_order(df: DataFrame) -> DataFrame:
    first = [F.coalesce(F.col("fecha_scraping"), F.lit("")).alias("fecha"), F.coalesce(F.col("aviso_id"), F.lit(0)).alias("id")]
    return df.withColumn("ord", F.struct(*first, "file", "block", "seq")).drop("file", "block", "seq")


def stream_raw(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The lines of a folder to which files are added, with their file and block. Parse them batch by batch with ``parse_batch``, which gives the order of ``read_raw``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def parse_batch(lines: DataFrame, schema: T.StructType = OBSERVATION) -> DataFrame:
    """Observations of one batch of stream_raw (in foreachBatch) with ``ord``: a block is read by one task from its beginning, so that row numbers order its lines."""
    return with_order(parse_lines(lines.withColumn("seq", F.monotonically_increasing_id()), schema=schema))


def unreadable(raw: DataFrame) -> DataFrame:
    """How many lines couldn't be read."""
    return raw.agg(F.count("*").alias("lines"), F.count("_corrupt").alias("unreadable"))


def append_raw(df: DataFrame, path: str) -> None:
    """Append observations, partitioned by period and area. Rows are brought together by those two before, and Spark splits large parts: so each run adds few files to a part, and a common area isn't one task's work."""
    df.hint("rebalance", "periodo", "area_scraping").write.mode("append").partitionBy("periodo", "area_scraping").parquet(path)


def read_appended(spark: SparkSession, path: str, schema: T.StructType, periods: list[str] | None = None, areas: list[str] | None = None) -> DataFrame:
    """What ``append_raw`` has written, of some periods or areas only: other parts' files aren't opened. The schema keeps an area or a period that looks like a number a text."""
    df = spark.read.schema(schema).parquet(path)
    for column, wanted in (("periodo", periods), ("area_scraping", areas)):
        df = df.where(F.col(column).isin(wanted)) if wanted is not None else df
    return df


def raw_partition(area: Column, period: Column) -> Column:
    """Name of an area's and period's part of the log."""
    return F.concat(F.lit("crudo_"), slug(area), F.lit("_"), period)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table with the declared schema; no rows if the path is absent. CSV has a header; a byte-order mark is accepted."""
    try:
        reader = spark.read.schema(schema)
        df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
        df.schema  # noqa: B018
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_version(df: DataFrame, root: str, columns: list[str] | None = None) -> str:
    """Write a whole new version of a table beside the old ones, so that it can be read while it is rewritten; gives the new path."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    (df.select(*columns) if columns else df).write.parquet(path)
    return path


def capture_plan(candidates: DataFrame, raw: DataFrame, key: str = "aviso_id") -> DataFrame:
    """Candidates whose detail hasn't been captured well yet: one row per id, its first listing and all terms."""
    listed = candidates.groupBy(key).agg(F.min_by("listing", "ord").alias("listing"), F.array_sort(F.collect_set("term")).alias("terms"))
    return listed.join(raw.where("detalle_ok").select(key), key, "left_anti")


_local: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share (spark.checkpoint.dir); where none is set, a temporary one, but only if everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for results that several passes need."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """An ordered result with the place of each row, from 1. The order is kept as it was made: rows are numbered in their sorted parts, and a row per part carries the number of those before."""
    placed = staged(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per part
    both = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return both.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*ordered.columns, name)


def running(df: DataFrame, order: list[Column], size: str, name: str = "before") -> DataFrame:
    """df with the sum of ``size`` over all rows that come before in the order. Rows are summed in their sorted parts, and a row per part carries the sum of those before."""
    placed = staged(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.sum(size).alias("_sum"))
    parts = sizes.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_first"))  # a row per part
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy("_id")) - F.col(size)
    return placed.withColumn("_in", inside).join(F.broadcast(parts), "_part").withColumn(name, F.col("_first") + F.col("_in")).select(*df.columns, name)


def tables_in(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(name): the tables that lie in a folder of whatever store."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)]
    return spark.createDataFrame([(f.removesuffix(suffix),) for f in sorted(found) if f.endswith(suffix)], "name string")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
