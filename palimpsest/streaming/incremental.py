"""Incremental panels: each batch folds to mergeable states, which join the stored ones.

States live in folders of buckets by key hash; a batch writes only the buckets that it touches, into a folder of its own. What counts is the last commit record: which folder holds
each bucket, and up to which batch every source has been folded in. It is put in place by one rename after all files are written, so that a writer that fails at any point leaves the state before
as it was, and its batch is folded in when it comes again. A batch counts as done by the record alone. Sources are told apart, since the numbers of another stream, or of a new checkpoint, begin again at 0.
A store has one writer at a time: two writers would want the same record, and the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.panel import latest
from palimpsest.sources.raw import remove


@dataclass
class Commit:
    """number: of the record; buckets: folder of each; done: last batch of each source."""

    number: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)


class PanelStore:
    """Stored states of a fold: ``fold`` makes states from observations, ``merge`` one state per key from several."""

    def __init__(self, spark: SparkSession, path: str, key: str, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.key, self.fold, self.merge, self.buckets = spark, path.rstrip("/"), key, fold, merge, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _store(self, name: str):
        """The path of a file or folder, and the file system that has it."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there, files = self._store(folder)
        return [s.getPath().getName() for s in files.listStatus(there)] if files.exists(there) else []

    def last_commit(self) -> Commit:
        records = sorted(n for n in self._names("_commits") if n.isdigit())
        if not records:
            return Commit()
        text = self.spark.read.text(f"{self.path}/_commits/{records[-1]}", wholetext=True).first()[0]
        return Commit(**json.loads(text))

    def _commit(self, record: Commit) -> None:
        """Written under another name first, then renamed, which either happens or doesn't, and not over another writer's record."""
        draft, files = self._store(f"_commits/draft-{uuid.uuid4().hex}")
        final, _ = self._store(f"_commits/{record.number:020d}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(vars(record)).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"another writer has made commit {record.number} of {self.path}")

    def _states(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/{f}" for f in sorted(folders))).drop("bucket", "version")

    def read(self) -> DataFrame | None:
        """The state of every bucket as last committed; None if there is none."""
        folders = list(self.last_commit().buckets.values())
        return self._states(folders) if folders else None

    def update(self, batch: DataFrame, version: int, source: str = "") -> None:
        """Fold a batch of a source into the store; for foreachBatch. Batches up to the last that was committed are skipped. States that it replaces, and what failed writers left, are deleted afterwards."""
        last = self.last_commit()
        if last.done.get(source, -1) >= version:
            return
        new = self._bucketed(self.fold(batch)).cache()
        try:
            touched = {str(r[0]) for r in new.select("bucket").distinct().collect()}  # at most one row per bucket
            record = Commit(last.number + 1, dict(last.buckets), {**last.done, source: version})
            if touched:
                states = new.drop("bucket")
                old = [f for b, f in last.buckets.items() if b in touched]
                if old:
                    states = states.unionByName(self._states(old))
                folder = f"{record.number}-{uuid.uuid4().hex[:8]}"
                merged = self._bucketed(self.merge(states)).withColumn("version", F.lit(folder))
                merged.write.mode("append").partitionBy("version", "bucket").parquet(self.path)
                record.buckets |= {b: f"version={folder}/bucket={b}" for b in touched}
            self._commit(record)
        finally:
            new.unpersist()
        self._sweep(record)

    def _sweep(self, record: Commit) -> None:
        """Delete what the last record doesn't name: replaced buckets, remains of failed writers, older records."""
        named = set(record.buckets.values())
        for version in self._names(""):
            if version.startswith("version="):
                inside = [f"{version}/{b}" for b in self._names(version) if b.startswith("bucket=")]
                for folder in inside if named & set(inside) else []:
                    if folder not in named:
                        remove(self.spark, f"{self.path}/{folder}")
                if not named & set(inside):
                    remove(self.spark, f"{self.path}/{version}")
        for name in self._names("_commits"):
            if name != f"{record.number:020d}":
                remove(self.spark, f"{self.path}/_commits/{name}")


def latest_store(spark: SparkSession, path: str, key: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = 16) -> PanelStore:
    """A stored bridge: of each combination of ``keys`` the row of the last observation. ``fold`` gives rows with their ``ord``."""
    last = lambda rows: latest(rows, keys, F.col("ord"))
    return PanelStore(spark, path, key, lambda batch: last(fold(batch)), last, buckets)


def _run(stream: DataFrame, each: Callable[[DataFrame, int, str], None], checkpoint: str) -> None:
    """All that has arrived, batch by batch, with the stream's own id, which its checkpoint keeps."""
    spark, ids = stream.sparkSession, []

    def one(df: DataFrame, n: int) -> None:
        if not ids:
            ids.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        each(df, n, ids[0])

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, store: PanelStore, checkpoint: str) -> None:
    """Fold everything that has arrived, then stop. The checkpoint says what has been read; with a new one, all that it reads counts as new, so that a replay needs a new store too."""
    _run(stream, store.update, checkpoint)


def new_only(stream: DataFrame, done: DataFrame, key: str = "aviso_id", ok: str = "detalle_ok") -> DataFrame:
    """Observations of entities that haven't been captured well yet; a failed capture is tried again."""
    return stream.join(done.where(ok).select(key).distinct(), key, "left_anti")


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def capture_store(spark: SparkSession, path: str, key: str, ok: str, ord: str, buckets: int = 16) -> PanelStore:
    """A store of captures: of each key its first good row, or its first bad one as long as there is none, with ``tries``, the rows that were tried."""
    first = F.struct(~F.col(ok), ord)

    def fold(batch: DataFrame) -> DataFrame:
        payload = [c for c in batch.columns if c != key]
        return batch.groupBy(key).agg(F.min_by(F.struct(*payload), first).alias("_row"), F.count("*").alias("tries")).select(key, "_row.*", "tries")

    def merge(states: DataFrame) -> DataFrame:
        payload = [c for c in states.columns if c not in (key, "tries")]
        return states.groupBy(key).agg(F.min_by(F.struct(*payload), first).alias("_row"), F.sum("tries").alias("tries")).select(key, "_row.*", "tries")

    return PanelStore(spark, path, key, fold, merge, buckets)


def capture_available(stream: DataFrame, store: PanelStore, checkpoint: str, ok: str, capture: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """Capture what has been sighted and isn't in the store yet, then stop; resumes where it stopped.

    Each batch is joined against the keys that are done (left anti), what remains is captured, and the outcome goes to the store: bad outcomes are tried again when their key is sighted again.
    ``stream`` should be ``deduplicated`` before, so that a sighting that comes twice within the watermark is tried once, and one that is later than that is left out.
    """

    def each(batch: DataFrame, n: int, source: str) -> None:
        done = store.read()
        store.update(capture(batch if done is None else new_only(batch, done, store.key, ok)), n, source)

    _run(stream, each, checkpoint)
