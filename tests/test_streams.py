"""Stored states when a writer fails, when a stream starts again, and when sightings repeat or come late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming.incremental import PanelStore, capture_available, capture_store, deduplicated, run_available

SCHEMA = "k long, v long"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def sums(spark, path):
    fold = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return PanelStore(spark, str(path), "k", fold, lambda s: s.groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")), 3)


def state(store):
    return {r.k: (r.v, r.n) for r in store.read().collect()}


class Broken(Exception):
    pass


@pytest.mark.parametrize("where", ["_commit", "_sweep", "write"])
def test_a_writer_that_fails(spark, tmp_path, monkeypatch, where):
    """After the write and before the commit, after the commit, and in the middle of the write: nothing is lost and nothing counts twice."""
    put(spark, tmp_path / "in", [(1, 10), (2, 20), (3, 30)])
    store = sums(spark, tmp_path / "store")
    run_available(stream(spark, tmp_path / "in"), store, str(tmp_path / "checkpoint"))
    put(spark, tmp_path / "in", [(1, 1), (4, 4)])

    def fail(self, record):
        raise Broken

    with monkeypatch.context() as m:
        if where == "write":  # one bucket is there, the other isn't
            merge = store.merge
            store.merge = lambda s: merge(s).withColumn("v", F.when(F.col("k") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
        else:
            m.setattr(PanelStore, where, fail)
        with pytest.raises(Exception, match="lost|Broken|STREAM_FAILED"):
            run_available(stream(spark, tmp_path / "in"), store, str(tmp_path / "checkpoint"))
    store = sums(spark, tmp_path / "store")
    before = {1: (10, 1), 2: (20, 1), 3: (30, 1)}
    after = before | {1: (11, 2), 4: (4, 1)}
    assert state(store) == (after if where == "_sweep" else before)
    run_available(stream(spark, tmp_path / "in"), store, str(tmp_path / "checkpoint"))
    assert state(store) == after
    put(spark, tmp_path / "in", [(k, 1) for k in range(1, 5)])
    run_available(stream(spark, tmp_path / "in"), store, str(tmp_path / "checkpoint"))
    assert state(store) == {k: (v + 1, n + 1) for k, (v, n) in after.items()}
    assert len(list((tmp_path / "store").glob("_commits/[!.]*"))) == 1
    files = {p.parent for p in (tmp_path / "store").glob("version=*/bucket=*/*.parquet")}
    assert len(files) == len(store.last_commit().buckets)  # remains are gone


def test_a_stream_with_a_new_checkpoint_loses_no_batch(spark, tmp_path):
    store = sums(spark, tmp_path / "store")
    for k in range(3):
        put(spark, tmp_path / "a", [(1, k)])
    run_available(stream(spark, tmp_path / "a"), store, str(tmp_path / "one"))
    put(spark, tmp_path / "b", [(1, 100), (2, 5)])
    run_available(stream(spark, tmp_path / "b"), store, str(tmp_path / "two"))
    assert state(store) == {1: (103, 4), 2: (5, 1)}
    run_available(stream(spark, tmp_path / "b"), store, str(tmp_path / "two"))
    assert state(store) == {1: (103, 4), 2: (5, 1)}
    assert sorted(store.last_commit().done.values()) == [0, 2]


def test_two_writers(spark, tmp_path):
    store, other = sums(spark, tmp_path / "store"), sums(spark, tmp_path / "store")
    rows = spark.createDataFrame([(1, 1)], SCHEMA)
    store.update(rows, 0)
    last = store.last_commit()
    store.update(rows, 1)
    other.last_commit = lambda: last  # it has read before the first one wrote
    with pytest.raises(Exception, match="another writer|PATH_NOT_FOUND"):
        other.update(rows, 0, "other")
    assert state(store) == {1: (2, 2)}


def test_captures_resume(spark, tmp_path):
    """Failed captures are tried again, good ones aren't; repeats are known, late sightings are left out, and a second run changes nothing."""
    day = lambda n: dt.datetime(2026, 8, 1) + dt.timedelta(days=n)
    schema = "sighting long, id long, at timestamp, good boolean"
    batches = [
        [(1, 10, day(0), False), (2, 11, day(0), True), (3, 12, day(1), False)],
        [(1, 10, day(0), False), (4, 10, day(1), True)],  # sighting 1 again
        [(5, 10, day(8), True), (6, 11, day(8), False), (7, 12, day(8), False)],
        [(9, 14, day(9), True)],
        [(8, 13, day(0), True), (2, 11, day(0), True)],  # both are later than the watermark of two batches ago, which counts
    ]
    calls = []

    def capture(batch):
        calls.append(sorted(r.id for r in batch.select("id").collect()))
        return batch

    store = capture_store(spark, str(tmp_path / "store"), "id", "good", "at", 2)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 4):
            source = deduplicated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "at", ["sighting"], "2 days")
            for _ in range(2):
                capture_available(source, store, str(tmp_path / "checkpoint"), "good", capture)
    assert [c for c in calls if c] == [[10, 11, 12], [10], [12], [14]]
    assert {r.id: (r.good, r.sighting, r.tries) for r in store.read().collect()} == {10: (True, 4, 2), 11: (True, 2, 1), 12: (False, 3, 2), 14: (True, 9, 1)}
