"""Clustering in rounds against plain linkage, ties included, and cuts against walking every merge."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import cluster
from tests.test_queries import plain_linkage


def table(spark, segments, jaccard):
    pairs = spark.createDataFrame([(s, a, b, j) for s, near in jaccard.items() for (a, b), j in near.items()], "segment string, a string, b string, jaccard double")
    items = spark.createDataFrame([(s, x) for s, names in segments.items() for x in names], "segment string, item string")
    return pairs, items


def similar(rng, names, share, values):
    """Some pairs have one of a few similarities: most neighbours are tied, as counts of few sets are."""
    return {(a, b): rng.choice(values) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < share}


@pytest.fixture(scope="module")
def segments():
    rng = random.Random(7)
    names = {f"s{k}": [f"i{j:03d}" for j in range(n)] for k, n in enumerate((60, 60, 40, 2, 1, 7))}
    shares, values = (0.1, 0.5, 0.02, 1.0, 0.0, 0.0), ((0.5, 0.25), (0.5, 0.4, 0.3, 0.2), (0.5,), (0.3,), (), ())
    return names, {s: similar(rng, x, share, v) for (s, x), share, v in zip(names.items(), shares, values, strict=True)}


@pytest.mark.parametrize("in_one_task", [0, 30, 2000])
def test_merges_with_ties(spark, segments, in_one_task):
    names, near = segments
    got = {}
    for r in cluster.upgma(*table(spark, names, near), in_one_task=in_one_task).collect():
        got.setdefault(r.segment, {})[r.step] = (r.left, r.right, r.height, r.size)
        assert r["items"] == len(names[r.segment])
    for s, own in names.items():
        merges = plain_linkage(own, {p: 1 - j for p, j in near[s].items()})
        assert [got.get(s, {})[k][:2] for k in range(len(merges))] == [m[:2] for m in merges], s
        assert [got[s][k][2:] for k in range(len(merges))] == [(pytest.approx(m[2]), len(m[3])) for m in merges]


@pytest.mark.parametrize("most", [3, 20])
def test_cuts_against_a_walk(spark, segments, most):
    names, near = segments
    pairs, items = table(spark, names, near)
    merges = cluster.upgma(pairs, items)
    listed = items.groupBy("segment").agg(F.array_sort(F.collect_set("item")).alias("items"))
    got = {(r.segment, r.k, r["item"]): r.label for r in cluster.cuts(merges, listed, most=most).collect()}
    want = {}
    for s, own in names.items():
        made = plain_linkage(own, {p: 1 - j for p, j in near[s].items()})
        for k in range(2, max(2, min(most, len(own))) + 1 if len(own) > 1 else 2):
            label = {x: i for i, x in enumerate(own)}
            for step, (_, _, _, members) in enumerate(made[: len(own) - k]):
                label.update(dict.fromkeys(members, len(own) + step))
            want |= {(s, k, x): label[x] for x in own}
    assert got == want


def test_a_chain_needs_no_walk_of_every_step(spark):
    """400 items, each nearest to the one before: a tree as tall as it can be."""
    names = [f"i{j:04d}" for j in range(400)]
    merges = spark.createDataFrame([("s", k, 0 if k == 0 else 400 + k - 1, k + 1, 0.001 * k, k + 2, 400) for k in range(399)], "segment string, step int, left int, right int, height double, size int, items int")
    listed = spark.createDataFrame([("s", names)], "segment string, items array<string>")
    got = {(r.k, r["item"]): r.label for r in cluster.cuts(merges, listed).collect()}
    for k in (2, 20):
        assert {got[k, names[i]] for i in range(400 - k + 1)} == {400 + 400 - k - 1} and got[k, names[-1]] == 399


def test_no_segments(spark):
    pairs, items = table(spark, {}, {})
    assert cluster.upgma(pairs, items).count() == 0 and cluster.upgma_in_rounds(pairs, items).count() == 0
