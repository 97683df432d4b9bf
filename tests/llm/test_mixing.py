"""The source mix against plain code, and on odd input."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from tests.llm.fixtures import documents, frame


def plain_targets(sizes, weights, most=3):
    """Shares by weight; what is above a cap is shared again by weight among the others, again and again."""
    target, free, rest = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while free and rest:
        total = sum(weights[i] for i in free)
        for i in free:
            target[i] += rest * weights[i] / total
        rest = Fraction(0)
        for i in [i for i in free if target[i] >= most * sizes[i]]:
            rest += target[i] - most * sizes[i]
            target[i] = Fraction(most * sizes[i])
            free.discard(i)
    return [float(t) for t in target]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000], [5, 0, 7, 900, 2, 2, 30], [10], [0, 0], [1, 10, 100, 1000, 10_000]])
def test_targets(spark, sizes):
    weights = [k % 3 + 1 for k in range(len(sizes))]
    df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "id int, size long, weight int")
    got = {r.id: r.target for r in mixing.targets(df, "size", "weight").collect()}
    assert [got[k] for k in range(len(sizes))] == pytest.approx(plain_targets(sizes, weights))


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_plan(rows):
    size, key = defaultdict(int), lambda s: (s is None, (s or "").encode())
    for _, text, _, source, _ in rows:
        size[source] += count_words(text)
    names = sorted(size, key=key)
    target = dict(zip(names, plain_targets([size[s] for s in names], [k % 3 + 1 for k in range(len(names))]), strict=True))
    out = []
    for i, text, _, source, _ in rows:
        rate = min(3.0, target[source] / size[source]) if size[source] else 0.0
        drawn = int(hashlib.md5(f"mix:{text or '' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, count_words(text), size[source], target[source], int(rate) + (drawn < rate - int(rate))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, a, [None, "", "a", "z", "é", "😀", "empty"][k % 6], c) for k, (i, t, a, _, c) in enumerate(documents(n=90))]
    return [*found, (8_000_001, None, None, None, None), (8_000_002, " \t\r", "en", "empty", 3), found[4], found[4]]


def test_plan_against_plain_code(spark, rows):
    df = frame(spark, rows).withColumn("size", F.lit("x")).withColumn("_source", F.lit(1)).withColumn("target", F.lit(2)).repartition(3)
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.copies) for r in mixing.plan(df).collect()), key=repr)
    for mine, theirs in zip(got, plain_plan(rows), strict=True):
        assert mine[:3] == theirs[:3] and mine[3] == pytest.approx(theirs[3]) and mine[4] == theirs[4]
    again = sorted(((r.doc_id, r.copies) for r in mixing.plan(df.repartition(7)).collect()), key=repr)
    assert again == sorted(((g[0], g[4]) for g in got), key=repr)


def test_mix_emits_the_copies(spark, rows):
    unique = [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:k]}]
    df = frame(spark, unique).withColumn("copy", F.lit("own"))
    copies = {r.doc_id: r.copies for r in mixing.plan(df).collect()}
    out = mixing.mix(df).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in copies.items() if n})
    assert all(r["copy"] == "own" for r in out) and {(r.doc_id, r["copy_"]) for r in out} == {(i, k + 1) for i, n in copies.items() for k in range(n)}


def test_taken_words_come_near_the_targets(spark):
    """Over 4,000 documents of 50 words, of which one source holds a third: within four standard deviations of independent draws."""
    rows = [(i, "w " * 50, "en", "big" if i % 3 == 0 else f"s{i % 7}", 100) for i in range(4000)]
    found = mixing.plan(frame(spark, rows)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 7)))
    by = found.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect()
    for r in by:
        p = r.target / (50 * r.n) % 1
        assert abs(r.taken - r.target) < 4 * 50 * (r.n * p * (1 - p)) ** 0.5 and r.most <= 3


def test_empty(spark):
    assert mixing.plan(frame(spark, documents(n=3)).where("false")).count() == 0
    assert mixing.mix(frame(spark, documents(n=3)).where("false")).count() == 0
