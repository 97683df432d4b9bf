"""Hard negatives and vector codes against brute force, and on odd input."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import codebooks, common, negatives
from palimpsest.llm import queries as registered

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_mix", "op13_vector_codes"])
def test_query_matches_its_statement(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registered.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({registered.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found)) and found


def vectors(seed, n, d, spread=0.2, groups=4, labels=3):
    """Rows around a few directions, with ties: some vectors repeat under other ids."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    rows = [(int(i), (centers[rng.integers(groups)] + spread * rng.normal(size=d)).tolist(), int(rng.integers(labels))) for i in rng.permutation(n)]
    return rows + [(n + k, v, (label + k) % labels) for k, (_, v, label) in enumerate(rows[:8])]


ODD = [
    (9001, None, 1),
    (9002, [], 1),
    (9003, [0.1, None, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], 0),
    (9004, [math.nan] * 8, 0),
    (9005, [math.inf] + [0.0] * 7, 0),
    (9006, [1.0], 0),
    (None, [0.5] * 8, 0),
    (9007, [0.0] * 8, 0),
]


def usable(rows):
    return [r for r in rows if r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_negatives(rows, every=10):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in usable(rows) if i is not None and label is not None]
    out, done = [], set()
    for a, av, al in rows:
        if a % every or a in done:
            continue
        done.add(a)
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, v, label in rows if i != a)
        for ps, p in [(-s, i) for s, i, label in scored if label == al][:5]:
            fits = [(i, -s) for s, i, label in scored if label != al and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"wave": 7, "first": 40, "growth": 3, "clusters": 3}, {"clusters": 1, "wave": 1}])
def test_negatives_against_all_products(spark, how):
    rows = vectors(1, 300 if how.get("wave") != 1 else 60, 8) + ODD + [(9010, [0.3] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("_v", F.lit(1)).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, **how).collect())
    assert got == plain_negatives(rows) and len({r[0] for r in got}) > 5


def test_negatives_of_rows_that_repeat_and_labels_that_are_texts(spark):
    rows = vectors(2, 80, 8)
    rows += [rows[0], rows[0], next(r for r in rows if r[0] == 10)]
    texts = spark.createDataFrame([(i, v, f"label {x}") for i, v, x in rows], "vec_id int, embedding array<float>, label string")
    numbers = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    got = [sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0).collect()) for df in (texts, numbers)]
    exact = [(i, np.array(v, np.float32).astype(float).tolist(), x) for i, v, x in rows]
    assert got[0] == got[1] == plain_negatives(exact)


def test_negatives_without_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int")
    for rows in (df.where("false"), df.where("vec_id < 9007"), df.where("vec_id = 9007")):
        out = negatives.mine(rows, F.lit(True))
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


def test_lists_end_early_and_bounds_hold(monkeypatch):
    """On tight groups most of a list is never multiplied, and what is found is what all products give."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = np.floor(256 * (centers[rng.integers(12, size=6000)] + 0.03 * rng.normal(size=(6000, 16))))
    at = rng.integers(6000, size=60)
    c = negatives.cluster_centers(x[at], 12, rounds=20)
    own = negatives.directions(x[at])
    cluster = (own @ c.T).argmax(axis=1)
    spread = np.zeros(len(c))
    np.maximum.at(spread, cluster, np.arccos(np.clip((own * c[cluster]).sum(axis=1), -1, 1)))
    wave = negatives.Wave(at.astype(np.int64), None, np.zeros(60, np.int64), x[at], cluster, c, spread)
    nothing = np.full(60, -np.inf)
    walkers = negatives.Walkers(np.arange(60), nothing, -nothing, nothing.copy(), True, 5)
    products = []
    array = np.ndarray
    monkeypatch.setattr(negatives, "_STRETCH", 128)

    class Counted(array):
        def __matmul__(self, other):
            products.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    wave.vectors = wave.vectors.view(Counted)
    kept = negatives.walk(wave, walkers, np.arange(6000), np.zeros(6000, np.int64), x, (np.zeros(0, np.int64),) * 3)
    score = np.asarray(x[at]) @ x.T
    for k in range(60):
        first = sorted((-s, i) for i, s in enumerate(score[k].astype(int).tolist()) if i != at[k])[:5]
        assert [(-s, i) for i, s in zip(kept[1][kept[0] == k], kept[2][kept[0] == k], strict=True)] == first
    assert sum(products) < 60 * 6000 / 2


def plain_codes(rows, entries, rounds, scale=1024, parts=4):
    rows = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    d = 8 // parts
    cut = [[v[p * d : (p + 1) * d] for v in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for x in cut[p]:
                own[near(x, book)[1]].append(x)
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(book)]
    out = [(r[0], [near(cut[p][k], books[p]) for p in range(parts)]) for k, r in enumerate(rows)]
    return books, sorted(((i, "".join(f"{at:02x}" for _, at in found), sum(e for e, _ in found)) for i, found in out), key=repr)


@pytest.mark.parametrize("entries", [1, 16, 256])
def test_codes_against_plain_rounds(spark, entries):
    rows = vectors(4, 120, 8, spread=0.5) + ODD + [(5, [-0.25] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_v", F.lit(0)).withColumn("code", F.lit(0)).repartition(3)
    books = codebooks.train(df, entries=entries, rounds=3)
    want, coded = plain_codes(rows, entries, 3)
    assert [b.tolist() for b in books] == want
    out = codebooks.encode(df, books, carried=("label",))
    assert sorted(((r.vec_id, r.code, r.error) for r in out.collect()), key=repr) == coded
    assert codebooks.digest(books) == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    back = {r.vec_id: r.vector for r in codebooks.decode(out, books).collect() if r.vec_id is not None}
    place = {i: code for i, code, _ in coded}
    assert all(v == [x / 1024 for p in range(4) for x in want[p][int(place[i][2 * p : 2 * p + 2], 16)]] for i, v in back.items() if i != 5)


def test_nearest_with_ties_and_repeated_entries():
    rng = np.random.default_rng(5)
    for d, m, high in ((1, 40, 5), (3, 1, 4), (4, 200, 3), (16, 256, 1000), (2, 300, 10**6)):
        entries, parts = rng.integers(-high, high, size=(m, d)), rng.integers(-high, high, size=(500, d))
        away = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        at, best = codebooks.nearest(parts, entries)
        assert (at == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int")
    for rows in (df.where("false"), df.where("vec_id <= 9002")):
        books = codebooks.train(rows)
        assert [b.shape[0] for b in books] == [0] * 4 and codebooks.encode(rows, books).count() == 0 and codebooks.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="don't divide"):
        codebooks.train(df.where("vec_id = 9006"))
    big = spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exact"):
        codebooks.train(big)


def test_global_rank(spark):
    rng = random.Random(6)
    names = [f"{rng.randrange(10**6):x}" for _ in range(5000)]
    df = spark.createDataFrame([(n,) for n in set(names)] + [(None,)], "name string").repartition(7)
    ranks = {r.name: r.r for r in common.global_rank(df, ["name"], "r").collect()}
    assert ranks == {n: k + 1 for k, n in enumerate([None, *sorted(set(names))])}
