import itertools
import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest import queries
from palimpsest.functions import stats
from palimpsest.operators import baskets, bridges, cluster, dims, explore, panel, profile, quality, rules, xwalk
from palimpsest.plans import consolidate as plan
from palimpsest.plans import reports
from palimpsest.sources import raw
from palimpsest.sources.schemas import MANAGED, OBSERVATION
from palimpsest.streaming.incremental import PanelStore, latest_store, run_available

LINES = [
    '{"aviso_id":1,"fecha_scraping":"2026-08-01","periodo":"2026_08","area_scraping":"Salud","terminos":["b","a"],"detalle_ok":true,"listado":{"nombreCargo":"***"},"detalle":{"estadoOferta":"PUBLICADA","idCompany":5,"nombreEmpresaFantasia":"Uno","carreras":[{"nombreCarrera":"Música"},{"nombreCarrera":"Arte"}],"habilidades":[{"nombreHabilidad":"x","nombreNivel":""}],"instituciones":[{"idInstitucion":9,"nombreInstitucion":"U"}],"fechaPublicacionFormatoIngles":"2026-07-30 12:10"}}',
    '{"aviso_id":1,"fecha_scraping":"2026-08-03","periodo":"2026_08","area_scraping":"Arte","terminos":["c"],"detalle_ok":false,"detalle_motivo":"http_404","listado":{"nombreCargo":"Jefe"}}',
    '{"aviso_id":1,"fecha_scraping":"2026-08-02","periodo":"2026_08","area_scraping":"Salud","terminos":[],"detalle_ok":true,"detalle":{"estadoOferta":"DESACTIVADA","idCompany":5}}',
    '{"aviso_id":2,"fecha_scraping":"2026-08-01","periodo":"2026_08","area_scraping":"Salud","terminos":["a","zz"],"detalle_ok":true,"detalle":{"estadoOferta":"DESACTIVADA","idCompany":5,"ofertaConfidencial":true,"nombreEmpresaFantasia":"Secreta"}}',
    '{"aviso_id":3,"fecha_scraping":"2026-08-01","periodo":"2026_08","area_scraping":"Salud","detalle_ok":true,"detalle":{"idCompany":6,"nombreEmpresaFantasia":"Seis","carreras":[{"nombreCarrera":"arte "},{"nombreCarrera":"MUSICA"}]}}',
    '{"aviso_id":4,"fecha',
]


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / "crudo_a_2026_08.jsonl").write_text("\n".join(LINES[:3]) + "\n")
    (path / "crudo_b_2026_08.jsonl").write_text("\n".join(LINES[3:]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def masters(spark, log):
    catalog = spark.createDataFrame([("Salud", "a", "A", 0), ("Arte", "a", "A2", 1), ("Arte", "b", "b", 2)], "area string, term string, name string, ordinal int")
    crosswalk = spark.createDataFrame([("Música", "Pedagogía", "", "programa_propio"), ("Música", "", "0215", "campo_iscedf"), ("arte", "Gone", "", "programa_propio")], "item string, program string, code string, kind string")
    programs = spark.createDataFrame([("Pedagogía", "Arte", "01", "011", "0114")], "program string, area string, broad string, narrow string, detailed string")
    codes = spark.createDataFrame([("0215",)], "code string")
    return plan.consolidate(raw.read_raw(spark, log), catalog, crosswalk, programs, codes)


def test_consolidate(spark, log, masters):
    assert raw.unreadable(raw.read_raw(spark, log)).first().unreadable == 1
    for name, columns in MANAGED.items():
        assert masters[name].columns == columns
    a = {r.aviso_id: r for r in masters["avisos"].collect()}
    assert (str(a[1].primera_vez_visto), str(a[1].ultima_vez_visto), a[1].n_corridas_visto, a[1].areas_scraping, a[1].terminos_busqueda) == ("2026-08-01", "2026-08-03", 3, ["Arte", "Salud"], ["a", "b", "c"])
    assert (a[1].estado_primero, a[1].estado_ultimo, str(a[1].fecha_desactivacion_detectada), a[1].calidad_duracion) == ("PUBLICADA", None, "2026-08-02", "observada")
    assert (a[1].titulo, a[1].empresa_id, a[1].n_entradas_declaradas, a[1].hash_entradas) == ("Jefe", None, 0, None)  # the last observation failed
    assert (a[2].calidad_duracion, a[2].empresa_nombre, a[2].n_terminos_sin_mapeo, a[2].sies_por_termino) == ("cota_superior", None, 1, ["A"])
    assert a[3].calidad_duracion == "censurada" and a[3].n_avisos_mismo_conjunto == 1
    entries = {(r.aviso_id, r.entrada_trabajando, r.termino_busqueda, r.fuente) for r in masters["aviso_entrada"].collect()}
    assert {(1, "Música", None, "declarada"), (1, "Arte", None, "declarada"), (2, None, "a", "keyword_only"), (2, None, "zz", "keyword_only"), (3, "arte ", None, "declarada")} <= entries
    assert {(r.aviso_id, r.programa_propio, r.isced_detallado_cod, r.atribucion_multiple) for r in masters["aviso_programa"].collect()} == {(1, "Pedagogía", "0114", True), (1, None, "0215", True)}
    company = {r.empresa_id: r for r in masters["empresas"].collect()}
    assert (company[5].empresa_nombre, company[5].n_avisos, company[5].siempre_confidencial, company[6].empresa_nombre) == ("Uno", 2, False, "Seis")


def test_consolidate_twice_is_once(spark, log, masters):
    doubled = raw.read_raw(spark, log).union(raw.read_raw(spark, log))
    states = plan.panel_states(plan.flatten(doubled)).collect()
    single = plan.panel_states(plan.flatten(raw.read_raw(spark, log))).collect()
    key = lambda rows: sorted((r.aviso_id, r.first_seen, r.last_seen, r.down_on) for r in rows)
    assert key(states) == key(single)


def test_reports(masters):
    report = reports.quality_report(masters)
    assert report["threshold"].first().gap is True
    assert report["concentration"].where("scope = '*'").first().n == 3
    found = reports.association_report(masters["aviso_programa"], masters["avisos"])
    assert found["funnel"].count() == 1 and found["pairs"].count() == 0


def test_upsert_keeps_manual_columns(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    old = spark.createDataFrame([("1", "old", "note"), ("3", "gone", "kept"), ("", "blank", "dropped")], "id string, name string, remark string")
    out = {str(r.id): (r.name, r.remark) for r in dims.upsert_preserving_manual(new.withColumn("id", F.col("id").cast("string")), old, ["id", "name"], "id").collect()}
    assert out == {"1": ("a", "note"), "2": ("b", None), "3": ("gone", "kept")}
    twice = spark.createDataFrame([("1", "z", {"k": "first"}), ("1", "a", {"k": "last"})], "id string, name string, remark map<string,string>").coalesce(1)
    assert [r.remark for r in dims.upsert_preserving_manual(new.where("id = 1"), twice, ["id", "name"], "id").collect()] == [{"k": "last"}]


def test_index_quantiles(spark):
    r = panel.index_quantiles(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long"), "v").first()
    assert (r.p25, r.p50, r.p75, r.maximum) == (2, 3, 4, 4)


def test_streamed_panel_equals_replay(spark, log, tmp_path):
    fold = lambda lines: plan.panel_states(plan.flatten(raw.parse_batch(lines)))
    merge = lambda s: panel.merge_panels(s, "aviso_id", ["periodos_visto", "areas_scraping", "terminos_busqueda"])
    store = PanelStore(spark, str(tmp_path / "states"), "aviso_id", fold, merge, 2)
    stream = raw.stream_raw(spark, log, files_per_trigger=1)
    run_available(stream, store, str(tmp_path / "checkpoint"))
    run_available(stream, store, str(tmp_path / "checkpoint"))  # nothing new
    got = panel.finish_panel(store.read(), "DESACTIVADA")
    want = panel.finish_panel(plan.panel_states(plan.flatten(raw.read_raw(spark, log))), "DESACTIVADA")
    pick = lambda df: sorted(tuple(str(x) for x in r) for r in df.select("aviso_id", "first_seen", "last_seen", "n_seen", "first_state", "last_state", "down_on", "terminos_busqueda", "duration_quality").collect())
    assert pick(got) == pick(want)


def test_order_of_a_stream_goes_by_line(spark, tmp_path):
    line = '{"aviso_id":1,"fecha_scraping":"2026-08-01","detalle_ok":true,"detalle":{"habilidades":[{"nombreHabilidad":"x","nombreNivel":"%s"}]}}'
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(line % n for n in ("low", "high", "last")) + "\n")
    skills = lambda lines: bridges.bridge(plan.flatten(raw.parse_batch(lines)), "aviso_id", F.col("_habilidades"), F.col("ord"), {"habilidad": F.col("item.nombreHabilidad"), "nivel": F.col("item.nombreNivel")}, with_order=True)
    store = latest_store(spark, str(tmp_path / "bridge"), "aviso_id", ["aviso_id", "habilidad"], skills, 2)
    for name, level in (("a", "last"), ("b", "newer")):
        if name == "b":
            (tmp_path / "log" / "b.jsonl").write_text((line % "newer").replace("08-01", "08-02") + "\n")
        run_available(raw.stream_raw(spark, str(tmp_path / "log"), 1), store, str(tmp_path / "checkpoint"))
        assert [r.nivel for r in store.read().collect()] == [level]
    assert len(list((tmp_path / "bridge").glob("version=*/bucket=*/*.parquet"))) == 1  # the state before is gone


def right_tail(a, b, c, d):
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    row, column, n = a + b, a + c, a + b + c + d
    return min(1.0, math.fsum(math.exp(log_choose(row, x) + log_choose(n - row, column - x) - log_choose(n, column)) for x in range(max(a, row + column - n, 0), min(row, column) + 1)))


def test_fisher_at_any_margin(spark):
    rng = random.Random(3)
    cases = [(1, 9999, 9999, 10001), (50, 1950, 1950, 2050), (0, 3, 4, 5), (3, 0, 0, 3), (0, 0, 5, 5), (5, 0, 5, 0), (250_000, 250_000, 250_000, 250_000), (250_900, 249_100, 249_100, 250_900), (10, 999_990, 999_990, 10), (900, 99_100, 100, 900_000)]
    cases += [tuple(rng.randrange(rng.choice([3, 40, 3000])) for _ in range(4)) for _ in range(300)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, b long, c long, d long")
    got = {r.i: r.p for r in rows.select("i", stats.fisher_right(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(right_tail(*c), rel=1e-6, abs=1e-12), c


def test_rows_without_p_are_no_tests(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.04), (4, 0.5)], "i int, p double")
    assert {r.i: r.q and round(r.q, 9) for r in stats.benjamini_hochberg(rows).collect()} == {1: 0.03, 2: None, 3: 0.06, 4: 0.5}
    assert [r.q for r in stats.benjamini_hochberg(rows.where("i = 2")).collect()] == [None]


def test_quantiles_by_ranges(spark):
    rng = random.Random(8)
    values = [("a", rng.randrange(10**6)) for _ in range(3000)] + [("b", 7)] * 50 + [("c", None), (None, 3), ("d", 1), ("d", 2)]
    df = spark.createDataFrame(values, "g string, v long")
    got = {r.g: (r.n, r.p25, r.p50, r.p75, r.maximum) for r in panel.index_quantiles(df, "v", ["g"], ranges=20).collect()}
    for g in ("a", "b", "d", None):
        v = sorted(x for h, x in values if h == g and x is not None)
        assert got[g] == (len(v), v[len(v) // 4], v[len(v) // 2], v[3 * len(v) // 4], v[-1])
    assert set(got) == {"a", "b", "d", None}


def test_quantiles_of_many_shapes(spark):
    """Ties, steps, one value that most rows have, and group sizes around every boundary."""
    rng = random.Random(9)
    shapes = {f"n{n}": [rng.random() for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 8, 49, 50, 51, 2000)}
    shapes |= {"same": [3.0] * 5000, "most": [1.0] * 4000 + [rng.random() for _ in range(900)], "steps": [float(k // 1000) for k in range(6000)], "edge": [0.0] * 1250 + [1.0] * 3750, "skew": [10.0 ** rng.randrange(-300, 300) for _ in range(3000)]}
    df = spark.createDataFrame([(g, v) for g, vs in shapes.items() for v in vs], "g string, v double").repartition(5)
    for ranges in (1, 200):
        got = {r.g: (r.n, r.p25, r.p50, r.p75, r.maximum) for r in panel.index_quantiles(df, "v", ["g"], ranges=ranges).collect()}
        assert got == {g: (len(v), v[len(v) // 4], v[len(v) // 2], v[3 * len(v) // 4], v[-1]) for g, v in ((g, sorted(vs)) for g, vs in shapes.items())}


def test_association_against_counting(spark):
    rng = random.Random(5)
    rows = [(b, i) for b in range(120) for i in rng.sample("abcdefgh", rng.randint(1, 5))]
    sets = baskets.baskets(spark.createDataFrame(rows, "b long, i string"), "b", "i").withColumn("o", F.col("b"))
    out = baskets.association(baskets.template_dedup(sets, "o")).collect()
    by = {}
    for b, i in rows:
        by.setdefault(b, set()).add(i)
    multi = [s for s in by.values() if len(s) > 1]
    for r in out:
        assert r.n == sum(r.a in s and r.b in s for s in multi) and r.na == sum(r.a in s for s in multi)
        assert r.jaccard == pytest.approx(r.n / (r.na + r.nb - r.n)) and r.q >= r.p - 1e-12
    degree = {r["item"]: r["degree"] for r in baskets.degrees(sets).collect()}
    assert sum(degree.values()) == sum(map(len, by.values()))


@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_pairs_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(g, sorted(rng.sample(range(40), rng.choice([0, 1, 2, 7, 8, 14, 15, 33])))) for g in "ab" for _ in range(12)]
    got = {(r.g, r.a, r.b): r.n for r in baskets.pair_counts(spark.createDataFrame(rows, "g string, items array<int>"), ["g"], block).collect()}
    assert got == Counter((g, a, b) for g, items in rows for a, b in itertools.combinations(items, 2))


def test_a_very_large_set_is_spread_over_tasks(spark):
    """6,000 items, so 17,997,000 pairs; counted by where they are made."""
    sets = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(5_999)), lambda x: x.cast("int")).alias("items"))
    made = baskets.block_pairs(sets, [], 128).groupBy(F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"), F.sum(F.col("p.b") - F.col("p.a")).alias("gap")).collect()
    total = sum(r.n for r in made)
    assert total == 6_000 * 5_999 // 2 and sum(r.gap for r in made) == sum(d * (6_000 - d) for d in range(6_000))
    assert len(made) >= 3 and max(r.n for r in made) < 0.6 * total


def test_clusters(spark):
    names = ["a", "b", "c", "d", "e"]
    near = [("s", "a", "b", 0.9), ("s", "a", "c", 0.4), ("s", "b", "c", 0.2), ("s", "d", "e", 0.8)]
    pairs = spark.createDataFrame(near, "segment string, a string, b string, jaccard double")
    table = cluster.distances(pairs, spark.createDataFrame([("s", x) for x in names], "segment string, item string"))
    merges = cluster.upgma_by_segment(table)
    heights = [round(r.height, 6) for r in merges.orderBy("step").collect()]
    assert heights == [0.1, 0.2, 0.7, 1.0]
    labels = cluster.cuts(merges, table.select("segment", "items"))
    two = {}
    for r in labels.where("k = 2").collect():
        two.setdefault(r.label, set()).add(r["item"])
    assert sorted(map(sorted, two.values())) == [["a", "b", "c"], ["d", "e"]]
    assert cluster.elbow(merges).first().k == 2
    groups = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "2")], "item string, group string")
    curve = cluster.agreement_curve(labels, groups)
    assert cluster.best_agreement(curve).first().asDict() == {"segment": "s", "k": 2, "ari": pytest.approx(1.0), "agrees": True}


def test_suggestions(spark):
    names = spark.createDataFrame([("Ingeniería Minas",), ("zzz",), ("de",)], "name string")
    canon = spark.createDataFrame([("Ingeniería en Minas", 0), ("Ingeniería de Minas", 1), ("Minas", 2)], "canon string, ord int")
    assert [tuple(r) for r in xwalk.suggest(names, canon, "name", "canon", "ord").collect()] == [("Ingeniería Minas", "Ingeniería en Minas", 1.0)]


def test_suggestions_come_from_the_whole_catalog(spark, tmp_path):
    parts = [(i, "STANDARD", "cold old plate") for i in range(80)] + [(80, "HOUSEHOLD", "customer")]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([("Customer#1", "HOUSEHOLD", 3)], "c_name string, c_mktsegment string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in queries.suggest_matches_whole(spark, str(tmp_path)).collect()] == [("Customer#1 HOUSEHOLD 3", "HOUSEHOLD customer household", 1.0)]


def test_spelling_of_equal_order_does_not_depend_on_row_order(spark):
    x = [("minas norte", 1, 5), ("MINAS NORTE", 1, 9), ("salud", 1, 2), ("Salud", 2, 1)]
    master = spark.createDataFrame([("minas norte",), ("Salud",)], "item string")
    for rows in (x, x[::-1]):
        found = rules.against_master(spark.createDataFrame(rows, "item string, ord int, weight long").coalesce(1), master).where("rule = 'V-08'")
        assert sorted((r["key"], r.detail, r.weight) for r in found.collect()) == [("MINAS NORTE", "minas norte", 9), ("salud", "Salud", 2)]


def test_rules_are_silent_on_a_clean_crosswalk(spark):
    x = spark.createDataFrame(
        [("Minas", 1, "programa_propio", "Minas", "", "", "exacta", "", "validado", "alta", 3), ("Salud", 1, "campo_iscedf", "", "09", "Salud y bienestar", "", "", "validado", "alta", 2)],
        "item string, ord int, kind string, program string, code string, code_name string, relation string, level string, state string, confidence string, weight long",
    )
    programs = spark.createDataFrame([("Minas", ["profesional"])], "program string, levels array<string>")
    codes = spark.createDataFrame([("09", "Salud y Bienestar")], "code string, name string")
    master = spark.createDataFrame([("Minas",), ("Salud",)], "item string")
    assert rules.validate(x, programs, codes, master).count() == 0
    worse = x.withColumn("program", F.when(F.col("item") == "Salud", "Ingeniería Civil en X").otherwise(F.col("program")))
    assert {r.rule for r in rules.validate(worse, programs, codes, master).collect()} >= {"V-04", "V-05", "V-13", "V-16"}
    renamed = rules.adopt_master_spelling(x, spark.createDataFrame([("MINAS ",)], "item string"))
    assert {r["item"] for r in renamed.collect()} == {"MINAS ", "Salud"}


def test_profiles(spark):
    df, dirty = profile.clean_names(spark.createDataFrame([(1, " "), (2, "x")], "` a` long, b string"))
    assert dirty == [" a"] and {r["column"]: r.filled for r in profile.fill_rates(df).collect()} == {"a": 2, "b": 1}
    drift = {r["column"]: r.origin for r in profile.schema_drift(df, "t", ["a", "c"], ["m"], ["a", "old"]).collect()}
    assert drift == {"a": "code", "c": "absent", "b": "unexpected", "old": "orphan gloss"}
    keys = profile.json_keys(spark.createDataFrame([('{"a":1,"b":[]}',), ('{"a":2}',), (None,)], "j string"), {"j": F.col("j")}).collect()
    assert {r.key: (r.n_records, r.filled, r.distinct_values) for r in keys} == {"a": (2, 2, 2), "b": (1, 0, 0)}


@pytest.mark.parametrize("cap", [3, 40, 400])
def test_key_profile_is_bounded_and_agrees(spark, cap):
    rng = random.Random(cap)
    rows = [(i, {"few": str(rng.randrange(4)), "some": str(rng.randrange(60)), "own": f"value {i} " + "x" * 300, "empty": rng.choice(["", "[]", "{}"]), "late": "z" if i > 900 else ""}) for i in range(1000)]
    rng.shuffle(rows)  # the order is given, not that of reading
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in rows], "i long, j string").repartition(6)
    got = {r.key: r for r in profile.key_profile(df, {"j": F.col("j")}, F.col("i"), cap=cap).collect()}
    other = {r.key: r for r in profile.json_keys(df, {"j": F.col("j")}, cap=cap).collect()}
    pick = lambda r: (r.level, r.n_records, r.filled, r.share, r.distinct_values)
    assert {k: pick(r) for k, r in got.items()} == {k: pick(r) for k, r in other.items()}
    for key in ("few", "some", "own", "late"):
        first = dict.fromkeys(p[key][:200] for _, p in sorted(rows, key=lambda r: r[0]) if p[key])
        assert got[key].examples == [v[:90] for v in list(first)[:6]]
    assert got["empty"].examples is None and got["empty"].distinct_values == 0
    states = list(profile._key_states(cap, 6)([pa.RecordBatch.from_pylist([{"level": "j", "key": "own", "ok": True, "v": f"{i}", "ord": i} for i in range(5000)])]))
    assert sum(b.num_rows for b in states) == 1 + max(cap + 1, 6)  # the counts, and cap + 1 values


def test_lookup(spark):
    names = spark.createDataFrame([("Música",), ("Música antigua",)], "name string")
    assert [tuple(r) for r in explore.find_name(names, "name", "MUSICA").collect()] == [("Música", "exact")]
    assert [r.match for r in explore.find_name(names, "name", "antig").collect()] == ["similar"]


def test_tables(spark, tmp_path):
    assert raw.read_table(spark, str(tmp_path / "none"), OBSERVATION).count() == 0
    path = raw.write_version(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "x.csv").write_bytes("﻿a,b\n1,x\n".encode())
    assert raw.read_table(spark, str(tmp_path / "x.csv"), spark.createDataFrame([], "a long, b string").schema, "csv").first().b == "x"


def test_appended_parts_are_pruned(spark, tmp_path):
    schema = "id long, periodo string, area_scraping string"
    path = str(tmp_path / "crudo")
    for run in (0, 1):
        rows = [(10 * run + i, f"2026_0{i % 3}", str(i % 2)) for i in range(6)]
        raw.append_raw(spark.createDataFrame(rows, schema).repartition(5), path)
    some = raw.read_appended(spark, path, spark.createDataFrame([], schema).schema, ["2026_01"], ["0"])
    assert sorted(tuple(r) for r in some.collect()) == [(4, "2026_01", "0"), (14, "2026_01", "0")]
    shown = some._jdf.queryExecution().executedPlan().toString()
    filters = shown.split("PartitionFilters: [")[1].split("]")[0]
    assert "(periodo#" in filters and "(area_scraping#" in filters
    assert len(some.inputFiles()) == 12  # of all parts, one file a part and run: few tasks, few files
    assert raw.read_appended(spark, path, some.schema).count() == 12
    name = spark.range(1).select(raw.raw_partition(F.lit("Ingeniería y Minas"), F.lit("2026_01"))).first()[0]
    assert name == "crudo_ingenieria_y_minas_2026_01"


def test_generic_and_empty(spark):
    df = spark.createDataFrame([], "k int, o string, t string, h string, areas array<string>")
    assert quality.threshold_gap(df, "k").first().gap is True
    assert quality.concentration(df, "o", "areas").count() == 0
    assert quality.reused_sets(df, "h", "k", "o").count() == 0
    assert math.isnan(stats.adjusted_rand(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first().ari)
