"""Operators whose intermediate tables must not outgrow their input: results against plain loops, and where their plans shuffle."""

import math
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import log_queries, queries, report_queries
from palimpsest.functions import stats
from palimpsest.operators import baskets, dims, xwalk
from palimpsest.plans import reports
from palimpsest.sources import raw

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_never_together_shuffles_no_pairs(spark, chunk):
    freq = {f"i{k:02d}": (3 + k % 4, "g" if k % 5 else "h") for k in range(30)} | {"rare": (2, "g"), "none": (9, ""), "null": (9, None)}
    items = spark.createDataFrame([(i, f, g) for i, (f, g) in freq.items()], "item string, degree long, g string")
    seen = {(a, b) for k, (a, b) in enumerate(combinations(sorted(freq), 2)) if k % 3 == 0}
    pairs = spark.createDataFrame([(a, b, 1) for a, b in seen], "a string, b string, n long")
    kept = {i: (f, g) for i, (f, g) in freq.items() if f >= 3 and g}
    want = [(g, a, b, na, nb) for a, (na, g) in kept.items() for b, (nb, h) in kept.items() if a < b and g == h and (a, b) not in seen]
    want.sort(key=lambda r: (-r[3] - r[4], *r[:3]))
    df = baskets.never_together(items, pairs, "item", "degree", "g", chunk=chunk)
    assert "Exchange" not in plan(df).split("Generate explode")[0].split("Initial Plan")[-1]  # nothing is moved once rows are pairs
    assert sorted(map(tuple, df.collect())) == sorted(want)
    placed = baskets.never_together(items, pairs, "item", "degree", "g", placed=True, chunk=chunk)
    assert sorted((r.place, *tuple(r)[:5]) for r in placed.collect()) == [(k, *r) for k, r in enumerate(want, 1)]


@pytest.mark.parametrize(("chunk", "block", "known"), [(1, 1, 64 << 20), (7, 16, 64 << 20), (1024, 64, 0)])
def test_places_of_absent_pairs_stage_no_row_an_item_and_chunk(spark, monkeypatch, chunk, block, known):
    stored = []

    def counting(df, name, keep=raw.staged):
        out = keep(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(baskets, "KNOWN_BYTES", known)
    monkeypatch.setattr(baskets, "TASK_ROWS", 50)
    for module in (baskets, raw):
        monkeypatch.setattr(module, "staged", counting)
    freq = {k: (3 + k * 7 % 90, k % 3) for k in range(240)}
    items = spark.createDataFrame([(k, f, g) for k, (f, g) in freq.items()] + [(None, 9, 1), (500, 9, None)], "item long, degree long, g int")
    seen = {(a, b) for a, b in combinations(freq, 2) if a * b % 11 == 3 or a == 30 or 100 < a < 120}
    pairs = spark.createDataFrame([(a, b) for a, b in seen for _ in range(1 + (a + b) % 2)], "a long, b long")
    want = [(g, a, b, na, nb) for a, (na, g) in freq.items() for b, (nb, h) in freq.items() if a < b and g == h and (a, b) not in seen]
    want.sort(key=lambda r: (-r[3] - r[4], *r[:3]))
    df = baskets.never_together(items, pairs, "item", "degree", "g", placed=True, chunk=chunk, block=block)
    assert "array_except" not in plan(df) and "Exchange hashpartitioning(group" in plan(df)
    assert sorted((r.place, *tuple(r)[:5]) for r in df.collect()) == [(k, *r) for k, r in enumerate(want, 1)]
    assert chunk == 1 or max(stored) < len(want) / 4  # by the items' blocks, though nearly each item has a frequency of its own
    plain = baskets.never_together(items, pairs, "item", "degree", "g", chunk=chunk, block=block)
    assert sorted(map(tuple, plain.collect())) == sorted(want)


def test_pairs_of_one_group_come_from_sets_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(queries, "staged", lambda df, name: stored.append(name) or raw.staged(df, name))
    df = queries.never_together(spark, DATA)
    assert stored == ["sets"] and "lineitem" not in plan(df)
    sets = spark.createDataFrame([([1, 3, 4, 6],), ([1, 2, 3],), (list(range(1, 9)),)], "items array<long>")
    own = baskets.pair_counts(sets, block=4, alike=F.col("a") % 2 == F.col("b") % 2)
    assert sorted(map(tuple, own.collect())) == sorted(tuple(r) for r in baskets.pair_counts(sets).collect() if r.a % 2 == r.b % 2)


def test_absent_pairs_of_no_items(spark):
    items, pairs = spark.createDataFrame([(1, 2, 1)], "item long, degree long, g int"), spark.createDataFrame([], "a long, b long")
    assert [baskets.never_together(items, pairs, "item", "degree", "g", placed=p).count() for p in (False, True)] == [0, 0]


@pytest.mark.parametrize("limit", [0, 1000])
def test_attribution_shuffles_mentions_only(spark, monkeypatch, limit):
    monkeypatch.setattr(xwalk, "SMALL_CATALOG", limit)
    monkeypatch.setattr(xwalk, "TASK_ROWS", 20)
    rows = spark.createDataFrame([(k, f"N{k * j % 7}") for k in range(40) for j in (1, 2, 2, 3)], "id long, item string")
    cross = spark.createDataFrame([(f"n{i}", f"p{j}" if j < 3 else "", "" if j < 3 else f"000{i}", "own" if j < 3 else "field") for i in range(6) for j in range(i % 5)], "item string, program string, code string, kind string")
    programs = spark.createDataFrame([(f"p{j}", "a", "07", "071", "0713") for j in range(2)], "program string, area string, broad string, narrow string, detailed string")
    codes = spark.createDataFrame([("0004",)], "code string")
    plain = xwalk.attribution(rows, cross, programs, codes, "id", "item")
    df = xwalk.attribution(rows, cross, programs, codes, "id", "item", 160)
    text = plan(df)
    assert limit == 0 or (text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text)  # mentions by entity, no destinations
    assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect())) and df.count() > 40


@pytest.mark.parametrize("kind", ["own", None])
def test_attribution_keeps_no_rows_by_entity_and_destination(spark, kind):
    names = [f"n{i:03d}" for i in range(150)]
    rows = spark.createDataFrame([(k, v) for k in range(6) for i, n in enumerate(names) if i % 5 >= k for v in (n, n.upper(), n)] + [(7, "unknown"), (8, None)], "id long, item string")
    cross = [(n, f"p{(i + j) % 40}", "", kind or f"kind{i % 3}") for i, n in enumerate(names) for j in range(i % 4)] + [(n, "", f"{i % 7:04d}", "field") for i, n in enumerate(names) if i % 2]
    cross = spark.createDataFrame(cross, "item string, program string, code string, kind string")
    programs = spark.createDataFrame([(f"p{j}", "a", "07", "071", "0713") for j in range(38)], "program string, area string, broad string, narrow string, detailed string")
    codes = spark.createDataFrame([("0004",)], "code string")
    plain = xwalk.attribution(rows, cross, programs, codes, "id", "item")
    df = xwalk.attribution(rows, cross, programs, codes, "id", "item", rows.count())
    text = plan(df)
    assert "destination" not in "".join(line for line in text.splitlines() if "Aggregate(keys=[id" in line) and "collect_set" not in text
    assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect())) and df.count() > 150


def test_item_dim_has_tasks_for_its_lines(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_LINES", 50)
    text = plan(queries.item_dim(spark, DATA))
    assert "Expand" not in text
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f", {-(-lines // 50)}), REPARTITION_BY_NUM" in text


def test_item_dim_counts_as_distinct_keys(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "a", 9), (2, "a", 9), (None, "a", 1), (None, "b", 1), (3, "c", None)], "id int, item string, n int")
    seen = spark.createDataFrame([("a", "x", "d")], "item string, area string, date string")
    got = {r.item: (r.n_all, r.n_specific) for r in dims.item_dim(rows, seen, "id", "item", "n", "date", "area", 5).collect()}
    assert got == {"a": (2, 1), "b": (0, 0), "c": (1, 0)}


def test_each_line_is_parsed_once(spark):
    text = plan(log_queries.log_declared(spark, DATA)).split("Initial Plan")[0]
    assert text.count("from_json(") == 1


def test_terms_meet_items_at_the_entity(spark):
    assert "Generate" not in plan(queries._terms(spark, DATA)) and ", term#" not in "".join(x for x in plan(queries._terms(spark, DATA)).splitlines() if "Join" in x)


def test_files_of_the_stream_grow_with_the_lines(spark, monkeypatch):
    made, stream = [], raw.stream_raw
    monkeypatch.setattr(log_queries, "FILE_LINES", 200)
    monkeypatch.setattr(raw, "stream_raw", lambda s, path, files: made.append((s.read.text(path).inputFiles(), files)) or stream(s, path, files))
    got = log_queries.stream_bridge(spark, DATA).collect()
    orders = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert made and len(made[0][0]) == -(-orders // 200) > 4 and made[0][1] == -(-len(made[0][0]) // 4)
    assert sorted(map(str, got)) == sorted(map(str, log_queries.master_skills(spark, DATA).collect()))


def test_steps_of_fisher_compute_ratios_only(spark):
    def exact(a, b, c, d):
        """Terms by their ratios from the mode outwards, all of them."""
        row, column, n = a + b, a + c, a + b + c + d
        low, high = max(0, row + column - n), min(row, column)
        mode = min(high, max(low, (row + 1) * (column + 1) // (n + 2)))
        terms = {mode: 1.0}
        for x in range(mode, high):
            terms[x + 1] = terms[x] * ((row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1)))
        for x in range(mode, low, -1):
            terms[x - 1] = terms[x] * (x * (n - row - column + x) / ((row - x + 1) * (column - x + 1)))
        return math.fsum(v for x, v in terms.items() if x >= a) / math.fsum(terms.values())

    margins = [(60_000, 60_000, 1_000_000), (300, 90_000, 100_000), (99_000, 98_000, 100_000), (40, 50_000, 100_000), (1000, 1000, 900_000), (3, 4, 9), (1, 1, 1)]
    tables = [(0, 0, 0, 0)]
    for row, column, n in margins:
        low, high, mean = max(0, row + column - n), min(row, column), row * column / n
        deviation = math.sqrt(mean * (n - row) / n * (n - column) / n)
        for x in {min(high, max(low, round(mean + k * deviation))) for k in (-5, -2, -0.3, 0, 0.3, 1, 3, 6, 20)}:
            tables.append((x, row - x, column - x, n - row - column + x))
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = df.select("*", stats.fisher_right(*(F.col(x) for x in "abcd")).alias("p"))
    text = plan(got.coalesce(1))
    assert "aggregate(sequence(" in text and all("CASE" not in x.split("lambdafunction(")[1] for x in text.split("aggregate(sequence(")[1:])
    for r in got.collect():
        assert r.p == pytest.approx(exact(*r[:4]) if sum(r[:4]) else 1.0, rel=1e-6, abs=1e-9), r


def test_pairs_in_place_are_those_of_blocks(spark):
    sets = spark.createDataFrame([("g", ["a", "b", "c", "d"]), ("g", ["b", "d"]), ("h", ["a"]), ("h", []), ("h", ["a", "d"])], "k string, items array<string>")
    want = Counter((k, *p) for k, items in sets.collect() for p in combinations(items, 2))
    for block in (1, 2, 512):
        df = baskets.pair_counts(sets, ["k"], block)
        assert {(r.k, r.a, r.b): r.n for r in df.collect()} == want
    assert "flatten" not in plan(baskets.pair_counts(sets.where(F.size("items") <= 512), ["k"])).split("Union")[1].split("Generate posexplode")[0]


def test_groups_of_crossing_pairs_take_no_lines(spark):
    df = queries.crossing_pairs(spark, DATA)
    assert not any("lineitem" in f for f in df.inputFiles()) and df.count()


def test_association_report_makes_its_sets_once(spark):
    df = report_queries.association_report(spark, DATA)
    assert not any(t in f for f in df.inputFiles() for t in ("lineitem", "orders", "part.parquet"))
    assert "rangepartitioning" not in plan(df)  # pairs that never occur are numbered, not sorted


def test_association_report_on_odd_lines(spark, tmp_path):
    """Lines of unknown parts, without order, part, number or flag, and an order twice, against the statement."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    some = lines.where("l_orderkey < 400")
    odd = some.withColumn("l_partkey", F.lit(10**9).cast("bigint")).unionByName(some.withColumn("l_partkey", F.lit(None).cast("bigint"))).where("l_orderkey % 3 = 0")
    for c in ("l_orderkey", "l_linenumber", "l_returnflag"):
        odd = odd.unionByName(some.where("l_orderkey % 4 = 1").withColumn(c, F.lit(None).cast(some.schema[c].dataType)))
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    orders = orders.where("o_orderkey % 7 > 0").unionByName(orders.where("o_orderkey % 5 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))))
    duck = duckdb.connect()
    for name, df in {"lineitem": lines.unionByName(odd), "orders": orders, "part": spark.read.parquet(f"{DATA}/part.parquet")}.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.execute(f"SELECT block, a, b, n FROM ({queries.oracle_sql()['association_report']})").fetchall()
    got = report_queries.association_report(spark, str(tmp_path)).select("block", "a", "b", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_association_report_from_attributions(spark):
    """Fields from the attributions or from a catalog; the places of absent pairs; the funnel's counts."""
    rows = [(e, i, "g" if i < "d" else "h") for e, items in enumerate(["ab", "ab", "ab", "abc", "bd", "bd", "ad", "c", "c", "c", "ce", "ce", "ce", ""]) for i in items]
    programs = spark.createDataFrame([(e, i, "programa_propio", 2, False, f) for e, i, f in rows], "aviso_id int, programa_propio string, tipo_entrada string, n_entradas_declaradas_aviso int, atribucion_multiple boolean, isced_estrecho_cod string")
    entities = spark.createDataFrame([(e, e % 2 if e < 12 else None) for e in range(13)], "aviso_id int, empresa_id int")
    catalog = programs.select(F.col("programa_propio").alias("item"), F.lit("x").alias("narrow")).distinct()
    own, given = reports.association_report(programs, entities, least=1), reports.association_report(programs, entities, least=1, fields=catalog)
    assert tuple(own["funnel"].first())[:4] == tuple(given["funnel"].first())[:4] == (13, 3, 10, 9)
    assert [(r.place, r.group, r.a, r.b) for r in own["never_together"].orderBy("place").collect()] == [(1, "h", "d", "e")]
    assert [(r.a, r.b) for r in given["never_together"].orderBy("place").collect()] == [("b", "e"), ("a", "e"), ("c", "d"), ("d", "e")]
    assert given["crossing"].count() == 0
