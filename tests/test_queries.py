"""Every registered query of the library against its DuckDB statement, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from palimpsest import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda x: round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
    return sorted(tuple(str(value(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([tuple(r[i] for i in at) for r in result.fetchall()])


def plain_linkage(names, distance):
    """Average linkage by going over all pairs again and again: (left, right, height, size) with ids after the leaves'."""
    members = {i: [x] for i, x in enumerate(names)}
    apart = {(i, j): distance.get((names[i], names[j]), 1.0) for i in members for j in members if i < j}
    out = []
    while len(members) > 1:
        height, i, j = min((d, i, j) for (i, j), d in apart.items())
        new = len(names) + len(out)
        for x in members:
            if x not in (i, j):
                at = [apart.pop((min(x, y), max(x, y))) for y in (i, j)]
                apart[x, new] = (len(members[i]) * at[0] + len(members[j]) * at[1]) / (len(members[i]) + len(members[j]))
        del apart[i, j]
        members[new] = members.pop(i) + members.pop(j)
        out.append((i, j, height, members[new]))
    return out


def plain_ari(a, b):
    pairs = lambda xs: sum(n * (n - 1) / 2 for n in Counter(xs).values())
    both, na, nb, total = pairs(list(zip(a, b, strict=True))), pairs(a), pairs(b), len(a) * (len(a) - 1) / 2
    expected = na * nb / total
    return (both - expected) / ((na + nb) / 2 - expected)


def test_clusters_against_plain_linkage(spark, duck):
    rows = duck.execute(queries.oracle_sql()["cluster_distances"].replace("round(1 - p.n / (fa.n + fb.n - p.n), 6)", "1 - p.n / (fa.n + fb.n - p.n)")).fetchall()
    counts = duck.execute("SELECT l_linestatus, p_name FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 3").fetchall()
    got = {(r.segment, r.step): r for r in queries.queries()["upgma_merges"](spark, DATA).collect()}
    elbows = {r.segment: r.k for r in queries.queries()["elbow_k"](spark, DATA).collect()}
    curve = {(r.segment, r.k): r.ari for r in queries.queries()["ari_curve"](spark, DATA).collect()}
    cuts = {r.segment: r for r in queries.queries()["best_cut"](spark, DATA).collect()}
    for segment in {s for s, _ in counts}:
        names = sorted(x for s, x in counts if s == segment)
        merges = plain_linkage(names, {(a, b): d for s, a, b, d in rows if s == segment})
        for step, (left, right, height, members) in enumerate(merges):
            r = got[segment, step]
            assert (r.left, r.right, r.size) == (left, right, len(members)) and r.height == pytest.approx(height, abs=1e-6)
        n, heights = len(names), [m[2] for m in merges]
        top = max(2, min(20, n // 2))
        jumps = [(heights[i + 1] - heights[i], n - i - 1) for i in range(n - 2) if 2 <= n - i - 1 <= top]
        assert elbows[segment] == (max(jumps)[1] if jumps else 2)
        for k in range(2, min(20, n) + 1):
            label = {x: x for x in names}
            for left, _, _, members in merges[: n - k]:
                label.update(dict.fromkeys(members, left + n * 1000))
            assert curve[segment, k] == pytest.approx(plain_ari([label[x] for x in names], [x.split(" ")[-1] for x in names]), abs=1e-6)
        own = {k: ari for (s, k), ari in curve.items() if s == segment}
        best = max(own, key=lambda k: (round(own[k], 6), -k))
        assert (cuts[segment].k, cuts[segment].ari, cuts[segment].agrees) == (best, pytest.approx(own[best], abs=1e-6), own[best] >= 0.2)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
