"""Best matches by token sets against all pairs, and with tokens that every row has."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import xwalk


def plain(left, right, floor):
    out = {}
    for name, t in left.items():
        scored = [(len(t & u) / len(t | u), -o, r) for r, (o, u) in right.items() if t & u]
        best = max(scored, default=None)
        if best and best[0] >= floor:
            out[name] = (best[2], pytest.approx(best[0]))
    return out


@pytest.mark.parametrize("floor", [0.1, 0.2, 0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("common", [0, 3, 20, 10**6])
def test_against_all_pairs(spark, floor, common):
    """Few words, so that ties, common words and equal sets abound."""
    rng = random.Random(int(floor * 10) + common)
    words = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(400)] + ["all"] * 60
    some = lambda: set(rng.sample(words, rng.randint(1, 6)))
    left, right = {i: some() for i in range(120)}, {i: (o, some()) for i, o in enumerate(rng.sample(range(1000), 150))}
    a = spark.createDataFrame([(i, sorted(t)) for i, t in left.items()] + [(-1, []), (-2, ["unheard"])], "_id long, _t array<string>")
    b = spark.createDataFrame([(i, o, sorted(t)) for i, (o, t) in right.items()] + [(-1, -1, [])], "_id long, _ord int, _t array<string>")
    got = {r["_id"]: (r["_best"], r["_score"]) for r in xwalk.best_matches(a, b, floor, common).collect()}
    assert got == plain(left, right, floor)


def test_tokens_of_all_rows_are_not_joined_row_by_row(spark):
    """12,000 names and 12,000 entries that all have the same two words: 144 million pairs would meet at either."""
    names = spark.range(12_000).select(F.concat(F.lit("household article "), F.lit("n"), F.col("id").cast("string"), F.lit("xx")).alias("name"))
    canon = spark.range(12_000).select(F.concat(F.lit("household article "), F.lit("e"), (F.col("id") + 6000).cast("string"), F.lit("yy")).alias("canon"), F.col("id").alias("ord"))
    canon = canon.union(spark.createDataFrame([("household article n7xx", 99_999)], "canon string, ord long"))
    out = xwalk.suggest(names, canon, "name", "canon", "ord", 0.3)
    found = {r["name"]: (r.suggestion, r.score) for r in out.collect()}
    assert len(found) == 12_000 and found["household article n7xx"] == ("household article n7xx", 1.0)
    assert {v for k, v in found.items() if k != "household article n7xx"} == {("household article e6000yy", 0.5)}


def test_no_names_and_no_catalog(spark):
    names = spark.createDataFrame([(None,), ("",), ("ab cd",), ("some name",)], "name string")
    canon = spark.createDataFrame([("some name", 1)], "canon string, ord int")
    assert [tuple(r) for r in xwalk.suggest(names, canon, "name", "canon", "ord").collect()] == [("some name", "some name", 1.0)]
    assert xwalk.suggest(names, canon.where("false"), "name", "canon", "ord").count() == 0
    assert xwalk.suggest(names.where("false"), canon, "name", "canon", "ord").count() == 0
