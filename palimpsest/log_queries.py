"""Registered queries over an observation log derived from orders, and over what the library makes of it.

An order is one observation of its customer (the entity) in the raw format: JSON lines with a listing and, unless the order's key is
a multiple of four, a detail. The statements start from orders and lineitem again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import baskets, bridges, cluster, explore, profile, quality, rules, xwalk
from palimpsest.plans import consolidate as plan
from palimpsest.queries import _DECLARED, _DEFECTIVE, _SIZED, UPPER, _defective, _segments, _sized, _t, day, declared, n, query, r6
from palimpsest.sources import raw
from palimpsest.streaming.incremental import latest_store, run_available

# ── The log ────────────────────────────────────────────────────────────────


def _pick(number: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


FILE_LINES = 100_000
SCHEDULES = ["Jornada mixta", "Teletrabajo full time", "Práctica profesional", "Part time en terreno", "Reemplazo"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """value (JSON), file, block, seq: one line per order."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    made = lambda prefix, by: F.concat(F.lit(prefix), (k % by).cast("string"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = F.slice(F.array(made("Carrera ", 8), made("Música ", 5)), F.lit(1), (k % 3).cast("int"))
    listing = F.struct(
        made("Cargo ", 7).alias("nombreCargo"), F.when(k % 6 == 0, "Empresa Confidencial").otherwise(F.concat(F.lit("E"), (F.col("o_custkey") % 10).cast("string"))).alias("nombreEmpresa"),
        F.concat(made("Town", 3), F.lit(", "), made("Region", 2)).alias("ubicacion"), F.concat(made("", 90), F.lit(".5,-"), made("", 70), F.lit(".25")).alias("geolocalizacion"),
        _pick(k, SCHEDULES).alias("nombreJornada"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fechaPublicacion"),
    )
    detail = F.struct(
        F.when(F.col("o_orderstatus") == "F", "DESACTIVADA").otherwise("PUBLICADA").alias("estadoOferta"), (F.col("o_custkey") % 10).alias("idCompany"),
        F.concat(F.lit("Firma "), (F.col("o_custkey") % 10).cast("string"), F.lit(" "), (k % 2).cast("string")).alias("nombreEmpresaFantasia"), (k % 9 == 0).alias("ofertaConfidencial"),
        (k % 2 == 0).alias("mostrarSueldo"), F.col("o_totalprice").alias("sueldo"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("fechaExpiracionFormatoIngles"),
        F.when(k % 3 == 0, "Sin experiencia").when(k % 3 == 1, "Mínimo").alias("nombreOperadorExperiencia"), F.when(k % 5 != 1, (k % 4).cast("double")).alias("aniosExperiencia"),
        F.transform(names, lambda x: F.struct(x.alias("nombreCarrera"))).alias("carreras"),
        F.array(F.struct(made("h", 6).alias("nombreHabilidad"), F.when(k % 2 == 0, "").otherwise(made("n", 5)).alias("nombreNivel"))).alias("habilidades"),
        F.array(F.struct((k % 12).alias("idInstitucion"), (k % 12 + 100).alias("idInstitucionSqlServer"), made("Inst ", 24).alias("nombreInstitucion"))).alias("instituciones"),
    )
    row = F.struct(
        F.col("o_custkey").alias("aviso_id"), date.alias("fecha_scraping"), F.date_format("o_orderdate", "yyyy_MM").alias("periodo"), F.col("o_orderpriority").alias("area_scraping"),
        F.array("o_orderstatus", made("t", 5)).alias("terminos"), (k % 4 != 0).alias("detalle_ok"), listing.alias("listado"), F.when(k % 4 != 0, detail).alias("detalle"),
    )
    return o.select(F.to_json(row).alias("value"), F.lit("orders").alias("file"), F.lit(0).cast("bigint").alias("block"), k.alias("seq"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return plan.flatten(raw.with_order(raw.parse_lines(_lines(spark, d))))


_OBS = f"""o AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS dt, o_orderkey % 4 <> 0 AS det, ['{"', '".join(SCHEDULES)}'][o_orderkey % 5 + 1] AS jornada,
[x.v FOR x IN [{{'i': 1, 'v': 'Carrera ' || o_orderkey % 8}}, {{'i': 2, 'v': 'Música ' || o_orderkey % 5}}] IF o_orderkey % 4 <> 0 AND x.i <= o_orderkey % 3] AS carreras FROM orders)"""


@query(f"""WITH {_OBS} SELECT k, 'Cargo ' || k % 7 AS titulo, CASE k % 5 WHEN 0 THEN 'Híbrido' WHEN 1 THEN 'Remoto' WHEN 3 THEN 'Presencial' ELSE 'No informado' END AS modalidad,
CASE k % 5 WHEN 2 THEN 'Práctica' WHEN 4 THEN 'Reemplazo' END AS tipo_contrato, CASE WHEN det THEN CASE k % 3 WHEN 0 THEN 'Sin experiencia' WHEN 1 THEN 'Mínimo' END END AS exp_operador,
CASE WHEN det AND k % 5 <> 1 THEN CAST(k % 4 AS DOUBLE) END AS exp_anios, CASE WHEN det AND (k % 3 < 2 OR k % 5 <> 1) THEN k % 3 = 0 AND k % 5 <> 1 AND k % 4 > 0 END AS exp_inconsistente,
k % 90 + 0.5::DOUBLE AS latitud, -(k % 70) - 0.25::DOUBLE AS longitud, 'Region' || k % 2 AS region, 'Town' || k % 3 AS comuna, CASE WHEN det AND k % 2 = 0 AND o_totalprice > 0 THEN o_totalprice END AS sueldo_liquido,
CASE WHEN det THEN k % 9 = 0 ELSE k % 6 = 0 END AS empresa_confidencial, CASE WHEN det THEN CASE WHEN k % 9 <> 0 THEN 'Firma ' || o_custkey % 10 || ' ' || k % 2 END WHEN k % 6 <> 0 THEN 'E' || o_custkey % 10 END AS empresa_nombre,
CASE WHEN det THEN 30 END AS vigencia, len(carreras) AS n_declared, strftime(dt, '%Y-%m-%d') AS published FROM o""")
def log_flatten(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    plain = ["titulo", "modalidad", "tipo_contrato", "exp_operador", "exp_anios", "exp_inconsistente", "latitud", "longitud", "region", "comuna", "sueldo_liquido", "empresa_confidencial", "empresa_nombre"]
    return o.select(F.col("ord.seq").alias("k"), *plain, F.col("vigencia_declarada_dias").alias("vigencia"), n(F.col("n_entradas_declaradas")).alias("n_declared"), day("fecha_publicacion").alias("published"))


@query(f"""WITH {_OBS}, l AS (SELECT strftime(o_orderdate, '%Y_%m') AS periodo, k % 50 = 0 AS bad FROM o)
SELECT CASE WHEN NOT bad THEN periodo END AS periodo, count(*) AS lines, count(*) FILTER (bad) AS unreadable FROM l GROUP BY 1""")
def log_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Written as text with broken lines, read again."""
    path = raw.scratch_dir(spark, "log")
    _lines(spark, d).select(F.when(F.col("seq") % 50 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")).alias("value")).write.text(path)
    return raw.read_raw(spark, path).groupBy("periodo").agg(F.count("*").alias("lines"), F.count("_corrupt").alias("unreadable"))


@query(f"""WITH {_OBS} SELECT 'crudo_' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') || '_' || strftime(dt, '%Y_%m') AS part, count(*) AS lines, count(*) FILTER (det) AS captured FROM o
WHERE strftime(dt, '%Y_%m') IN ('1995_01', '1995_02') AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def log_appended(spark: SparkSession, d: str) -> DataFrame:
    """The log appended in two runs, partitioned, and two months of two areas of it read back."""
    path, log = raw.scratch_dir(spark, "crudo"), raw.with_order(raw.parse_lines(_lines(spark, d)))
    for k in (0, 1):
        raw.append_raw(log.where(F.col("ord.seq") % 2 == k), path)
    some = raw.read_appended(spark, path, log.schema, ["1995_01", "1995_02"], ["1-URGENT", "5-LOW"])
    part = raw.raw_partition(F.col("area_scraping"), F.col("periodo")).alias("part")
    return some.groupBy(part).agg(F.count("*").alias("lines"), F.count_if("detalle_ok").alias("captured"))


_LAST = "row_number() OVER (PARTITION BY {} ORDER BY dt DESC, k DESC) = 1"


@query(f"""WITH {_OBS}, g AS (SELECT o_custkey, k, dt, unnest(carreras) AS item, len(carreras) AS n FROM o), t AS (SELECT DISTINCT o_custkey, unnest([o_orderstatus, 't' || k % 5]) AS term FROM o WHERE det AND len(carreras) = 0)
SELECT o_custkey AS aviso_id, item, NULL AS term, 'declarada' AS source, n AS n_declared FROM g QUALIFY {_LAST.format('o_custkey, item')} UNION ALL SELECT o_custkey, NULL, term, 'keyword_only', 0 FROM t""")
def log_declared(spark: SparkSession, d: str) -> DataFrame:
    """Declared items, and search terms of observations that declare none."""
    out = bridges.declared_and_keyword(_observations(spark, d), "aviso_id", F.col("_carreras"), F.col("_terminos"), F.col("detalle_ok"), F.col("ord"))
    return out.withColumn("n_declared", n(F.col("n_declared")))


_CATALOG = "c AS (SELECT p_name AS name, p_brand AS area, 't' || p_partkey % 4 AS term, p_partkey AS ordinal FROM part), ci AS (SELECT term, first(name ORDER BY ordinal) AS name, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM c GROUP BY 1)"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_brand").alias("area"), F.concat(F.lit("t"), (F.col("p_partkey") % 4).cast("string")).alias("term"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))


def _masters(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    part = _t(spark, d, "part")
    names = part.select(F.concat(F.lit("carrera "), (F.col("p_partkey") % 6).cast("string")).alias("item"), F.col("p_type").alias("program"), F.lit("").alias("code"), F.lit("programa_propio").alias("kind")).distinct()
    programs = part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("program"), F.substring("p_type", 1, 1).alias("area"), F.lit("07").alias("broad"), F.lit("071").alias("narrow"), F.lit("0713").alias("detailed")).distinct()
    codes = spark.createDataFrame([("0713",)], "code string")
    return plan.consolidate(raw.with_order(raw.parse_lines(_lines(spark, d))), _catalog(spark, d), names, programs, codes)


@query(f"""WITH {_OBS}, {_CATALOG}, t AS (SELECT DISTINCT o_custkey, unnest([o_orderstatus, 't' || k % 5]) AS term FROM o)
SELECT o_custkey AS aviso_id, t.term AS termino, ci.name AS carrera, coalesce(areas, '') AS areas, ci.term IS NOT NULL AS mapeado FROM t LEFT JOIN ci USING (term)""")
def master_terms(spark: SparkSession, d: str) -> DataFrame:
    return _masters(spark, d)["aviso_termino"].select("aviso_id", F.col("termino_busqueda").alias("termino"), F.col("carrera_sies").alias("carrera"), F.array_join("areas_sies", ",").alias("areas"), F.col("mapeado"))


_SKILLS = f"""WITH {_OBS} SELECT o_custkey AS aviso_id, 'h' || k % 6 AS habilidad, CASE WHEN k % 2 = 1 THEN 'n' || k % 5 END AS nivel FROM o WHERE det QUALIFY {_LAST.format("o_custkey, 'h' || k % 6")}"""


@query(_SKILLS)
def master_skills(spark: SparkSession, d: str) -> DataFrame:
    return _masters(spark, d)["aviso_habilidad"]


@query(_SKILLS)
def stream_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The same bridge from the log as a stream of files, batch by batch."""
    path = raw.scratch_dir(spark, "log")
    # Files by key, so that later files hold later lines: the order of equal dates goes by file and line. Their number grows with the lines, so that one task's sort doesn't; they come in four batches.
    files = max(4, -(-_t(spark, d, "orders").count() // FILE_LINES))
    _lines(spark, d).repartitionByRange(files, "seq").sortWithinPartitions("seq").select("value").write.text(path)
    skills = lambda batch: bridges.bridge(plan.flatten(raw.parse_batch(batch)), "aviso_id", F.col("_habilidades"), F.col("ord"), {"habilidad": F.col("item.nombreHabilidad"), "nivel": F.nullif(F.col("item.nombreNivel"), F.lit(""))}, with_order=True)
    store = latest_store(spark, raw.scratch_dir(spark, "bridge"), "aviso_id", ["aviso_id", "habilidad"], skills, 4)
    run_available(raw.stream_raw(spark, path, -(-files // 4)), store, raw.scratch_dir(spark, "stream"))
    return store.read().drop("ord")


@query(f"""WITH {_OBS}, i AS (SELECT k % 12 AS id, o_custkey, k, dt, len(carreras) AS n FROM o WHERE det), b AS (SELECT * FROM i QUALIFY {_LAST.format('o_custkey, id')})
SELECT i.id, any_value(i.id) + 100 AS alt, first('Inst ' || k % 24 ORDER BY dt, o_custkey, k) AS nombre, any_value(nb.a) AS n_avisos, any_value(nb.s) AS n_specific, strftime(min(dt), '%Y-%m-%d') AS first_seen, strftime(max(dt), '%Y-%m-%d') AS last_seen
FROM i JOIN (SELECT id, count(*) AS a, count(*) FILTER (n <= 30) AS s FROM b GROUP BY 1) nb ON nb.id = i.id GROUP BY 1""")
def master_institutions(spark: SparkSession, d: str) -> DataFrame:
    m = _masters(spark, d)["instituciones"]
    return m.select(
        F.col("id_institucion").alias("id"), F.col("id_institucion_alt").alias("alt"), "nombre", "n_avisos", F.col("n_avisos_especificos").alias("n_specific"), day("primera_vez_visto").alias("first_seen"), day("ultima_vez_visto").alias("last_seen")
    )


@query(f"""WITH {_OBS}, x AS (SELECT DISTINCT 'carrera ' || p_partkey % 6 AS item, p_type AS program FROM part), w AS (SELECT item, count(*) AS goals FROM x GROUP BY 1),
g AS (SELECT o_custkey, k, dt, unnest(carreras) AS item, len(carreras) AS n FROM o), b AS (SELECT * FROM g QUALIFY {_LAST.format('o_custkey, item')}), m AS (SELECT o_custkey, max(n) AS most FROM b GROUP BY 1)
SELECT b.o_custkey AS aviso_id, x.program, left(x.program, 1) AS area, string_agg(DISTINCT b.item, ',' ORDER BY b.item) AS origins, bool_or(goals > 1) AS several, any_value(most) AS n_declared
FROM b JOIN x ON x.item = lower(b.item) JOIN w ON w.item = x.item JOIN m ON m.o_custkey = b.o_custkey WHERE x.program <> 'SMALL' GROUP BY 1, 2""")
def master_programs(spark: SparkSession, d: str) -> DataFrame:
    m = _masters(spark, d)["aviso_programa"]
    return m.select("aviso_id", F.col("programa_propio").alias("program"), F.col("area_sies").alias("area"), F.array_join("entradas_origen", ",").alias("origins"), F.col("atribucion_multiple").alias("several"), n(F.col("n_entradas_declaradas_aviso")).alias("n_declared"))


@query(f"""WITH {_OBS}, s AS (SELECT *, CASE WHEN det THEN o_custkey % 10 END AS company FROM o), l AS (SELECT o_custkey, det, CASE WHEN det THEN o_custkey % 10 END AS company, CASE WHEN det THEN k % 9 = 0 ELSE k % 6 = 0 END AS hidden FROM o QUALIFY {_LAST.format('o_custkey')}),
v AS (SELECT company, 'Firma ' || company || ' ' || k % 2 AS name, count(*) AS n, min((dt, o_custkey, k)) AS first FROM s WHERE det AND k % 9 <> 0 GROUP BY 1, 2)
SELECT company AS id, (SELECT first(name ORDER BY v.n DESC, v.first) FROM v WHERE v.company = s.company) AS name, (SELECT '{{' || string_agg('"' || name || '":' || v.n, ',' ORDER BY name) || '}}' FROM v WHERE v.company = s.company) AS names,
count(DISTINCT o_custkey) AS n_avisos, (SELECT count(*) FILTER (hidden) FROM l WHERE l.company = s.company) AS n_hidden, strftime(min(dt), '%Y-%m-%d') AS first_seen, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS areas
FROM s WHERE company IS NOT NULL GROUP BY company""")
def master_companies(spark: SparkSession, d: str) -> DataFrame:
    m = _masters(spark, d)["empresas"]
    return m.select(
        F.col("empresa_id").alias("id"), F.col("empresa_nombre").alias("name"), F.col("nombres_observados").alias("names"), "n_avisos", F.col("n_avisos_confidenciales").alias("n_hidden"), day("primera_vez_visto").alias("first_seen"), F.array_join("areas", ",").alias("areas")
    )


@query(f"""WITH {_OBS} SELECT o_custkey AS aviso_id, count(*) AS n_seen, strftime(min(dt), '%Y-%m-%d') AS first_seen, strftime(max(dt), '%Y-%m-%d') AS last_seen, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS areas,
last('Cargo ' || k % 7 ORDER BY dt, k) AS titulo, last(CASE WHEN det THEN CASE WHEN o_orderstatus = 'F' THEN 'DESACTIVADA' ELSE 'PUBLICADA' END ELSE '-' END ORDER BY dt, k) AS last_state,
strftime(min(dt) FILTER (det AND o_orderstatus = 'F'), '%Y-%m-%d') AS down_on, last(det ORDER BY dt, k) AS ok FROM o GROUP BY 1""")
def master_entities(spark: SparkSession, d: str) -> DataFrame:
    m = _masters(spark, d)["avisos"]
    return m.select(
        "aviso_id", F.col("n_corridas_visto").alias("n_seen"), day("primera_vez_visto").alias("first_seen"), day("ultima_vez_visto").alias("last_seen"), F.array_join("areas_scraping", ",").alias("areas"), "titulo",
        F.coalesce("estado_ultimo", F.lit("-")).alias("last_state"), day("fecha_desactivacion_detectada").alias("down_on"), F.col("detalle_ok").alias("ok"),
    )


@query("""WITH c AS (SELECT o_custkey AS aviso_id, o_orderpriority AS term, o_orderkey AS ord, 'l' || o_orderkey AS listing FROM orders)
SELECT aviso_id, first(listing ORDER BY ord) AS listing, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM c WHERE aviso_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0) GROUP BY 1""")
def capture_plan_listed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates merged over their lists, without those captured well."""
    o = _t(spark, d, "orders")
    candidates = o.select(F.col("o_custkey").alias("aviso_id"), F.col("o_orderpriority").alias("term"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("l"), F.col("o_orderkey").cast("string")).alias("listing"))
    done = o.select(F.col("o_custkey").alias("aviso_id"), (F.col("o_orderkey") % 11 == 0).alias("detalle_ok"))
    return raw.capture_plan(candidates, done).withColumn("terms", F.array_join("terms", ","))


# ── Levels and names ───────────────────────────────────────────────────────

_ORDER = ["tecnico", "profesional", "profesional_con_grado"]


@query("""WITH a AS (SELECT p_partkey AS k, ['tecnico', 'profesional', 'licenciatura'][p_partkey % 3 + 1] AS a, ['profesional_con_grado', 'otro', 'tecnico'][p_size % 3 + 1] AS b,
['Técnico en ', 'Ingeniería Civil en ', 'Arte ', 'Pedagogía en '][p_partkey % 4 + 1] || p_name AS name FROM part), f AS (SELECT *, CASE a WHEN 'licenciatura' THEN 'profesional_con_grado' ELSE a END AS fa FROM a)
SELECT k, CASE WHEN fa = b THEN fa WHEN b = 'otro' OR list_position(['tecnico', 'profesional', 'profesional_con_grado'], fa) < list_position(['tecnico', 'profesional', 'profesional_con_grado'], b) THEN fa || ' | ' || b ELSE b || ' | ' || fa END AS levels,
CASE WHEN fa = b THEN fa || '=' || CAST(round(30.5 + k % 7, 1) AS VARCHAR) ELSE fa || '=30.5,' || b || '=' || CAST(CAST(k % 7 AS DOUBLE) AS VARCHAR) END AS shares,
CASE k % 4 WHEN 0 THEN 'tecnico' WHEN 2 THEN NULL ELSE 'superior' END AS stated, CASE k % 4 WHEN 2 THEN 'arte ' || regexp_extract(name, '^Arte (.*)$', 1) ELSE regexp_extract(name, ' en (.*)$', 1) END AS core FROM f""")
def level_functions(spark: SparkSession, d: str) -> DataFrame:
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    a, b = _pick(k, ["tecnico", "profesional", "licenciatura"]), _pick(F.col("p_size"), ["profesional_con_grado", "otro", "tecnico"])
    name = F.concat(_pick(k, ["Técnico en ", "Ingeniería Civil en ", "Arte ", "Pedagogía en "]), "p_name")
    shares = text.level_shares(F.concat(a, F.lit(" 30.5% | "), b, F.lit(" "), (k % 7).cast("string"), F.lit("%")))
    shown = F.array_join(F.transform(shares, lambda s: F.concat(s["level"], F.lit("="), s["share"].cast("string"))), ",")
    return p.select(k.alias("k"), text.list_text(text.level_list(F.concat_ws(" | ", a, b), _ORDER)).alias("levels"), shown.alias("shares"), text.level_of_name(name).alias("stated"), text.core_name(name).alias("core"))


# ── Association ────────────────────────────────────────────────────────────

#: Items of a line: bands of its order's key that depend on each other (some overlap in one hundredth only), and the flag, which depends on nothing.
_BANDS = """bx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_filter([CASE WHEN l_orderkey % 100 < 50 THEN 'low' END, CASE WHEN l_orderkey % 100 >= 49 THEN 'high' END, CASE WHEN l_orderkey % 4 = 0 THEN 'even4' END, CASE WHEN l_orderkey % 2 = 0 THEN 'even' END, 'flag' || l_returnflag], lambda x: x IS NOT NULL)) AS item FROM lineitem),
e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, item FROM bx), f AS (SELECT item, count(*) AS n FROM e GROUP BY 1), tt AS (SELECT count(*) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM e)),
m AS (SELECT x.item AS a, y.item AS b, count(*) AS n, any_value(fx.n) AS na, any_value(fy.n) AS nb, any_value(total) AS total FROM e x JOIN e y USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) JOIN f fx ON fx.item = x.item JOIN f fy ON fy.item = y.item, tt WHERE x.item < y.item GROUP BY 1, 2),
p0 AS (SELECT *, least(1.0, list_sum(list_transform(range(n, least(na, nb) + 1), lambda x: exp(lgamma(na + 1) - lgamma(x + 1) - lgamma(na - x + 1) + lgamma(total - na + 1) - lgamma(nb - x + 1) - lgamma(total - na - nb + x + 1) - lgamma(total + 1) + lgamma(nb + 1) + lgamma(total - nb + 1))))) AS p FROM m WHERE total - na - nb + n >= 0),
p1 AS (SELECT *, least(1.0, min(p * cnt / rk) OVER (ORDER BY p DESC, a, b ROWS UNBOUNDED PRECEDING)) AS q_row FROM (SELECT *, count(*) OVER () AS cnt, row_number() OVER (ORDER BY p, a DESC, b DESC) AS rk FROM p0)), p2 AS (SELECT *, min(q_row) OVER (PARTITION BY p) AS q FROM p1)"""


def _bands(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    items = F.array(F.when(k % 100 < 50, "low"), F.when(k % 100 >= 49, "high"), F.when(k % 4 == 0, "even4"), F.when(k % 2 == 0, "even"), F.concat(F.lit("flag"), "l_returnflag"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = _t(spark, d, "lineitem").select(*keys, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("item"))
    return baskets.association(lines.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items")))


@query(f"WITH {_BANDS} SELECT a, b, n, na, nb, round(p, 5) AS p, round(q, 5) AS q FROM p2")
def association_wide_margins(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that avoid each other, that go together, and that have nothing to do with each other, with margins that grow with the table."""
    return _bands(spark, d).select("a", "b", "n", "na", "nb", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


@query(f"WITH {_BANDS} SELECT count(*) AS pairs, count(*) FILTER (n >= 900) AS repeated, count(*) FILTER (n < 900) AS single, count(*) FILTER (q < 0.05) AS significant FROM p2")
def pair_support(spark: SparkSession, d: str) -> DataFrame:
    return baskets.support_counts(_bands(spark, d), 900)


@query(f"WITH {_BANDS} SELECT a, b, n FROM p2 WHERE n >= 2 ORDER BY q, n DESC, a, b")
def pairs_repeated(spark: SparkSession, d: str) -> DataFrame:
    return baskets.repeated_pairs(_bands(spark, d)).select("a", "b", "n")


@query(f"WITH {_BANDS} SELECT a, b, right(a, 1) AS group_a, right(b, 1) AS group_b, n FROM p2 WHERE q < 0.05 AND right(a, 1) <> right(b, 1)")
def crossing_significant(spark: SparkSession, d: str) -> DataFrame:
    pairs = _bands(spark, d)
    groups = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().withColumn("g", F.right("item", F.lit(1)))
    return baskets.crossing(pairs, groups, "item", "g").select("a", "b", "group_a", "group_b", "n")


@query(f"WITH {_SIZED} SELECT count(*) FILTER (k > {UPPER}) AS generic, count(*) FILTER (k <= {UPPER} AND o_orderstatus <> 'O') AS field_only, count(*) FILTER (k <= {UPPER} AND o_orderstatus = 'O') AS counted FROM z")
def excluded_rows(spark: SparkSession, d: str) -> DataFrame:
    return baskets.excluded(_sized(spark, d), "k", "o_orderstatus", "O", UPPER)


def _cards(spark: SparkSession, d: str) -> DataFrame:
    catalog = _t(spark, d, "part").groupBy(F.col("p_name").alias("item")).agg(F.max(F.concat_ws(" | ", _pick(F.col("p_size"), ["profesional", "licenciatura"]), F.lit("tecnico"))).alias("levels"), F.lit("tecnico 40% | licenciatura 60%").alias("shares"), F.min("p_type").alias("area"), F.min("p_brand").alias("narrow"))
    rows = declared(spark, d).withColumn("origins", F.array("brand"))
    return baskets.cards(rows, "l_orderkey", "item", "origins", catalog=catalog, order=_ORDER).join(catalog.select("item", "area", "narrow"), "item")


_CARDS = _DECLARED + """, lv AS (SELECT p_name AS item, max(CASE p_size % 2 WHEN 0 THEN 'profesional' ELSE 'licenciatura' END) AS m, min(p_type) AS area, min(p_brand) AS narrow FROM part GROUP BY 1),
nt AS (SELECT item, count(DISTINCT l_orderkey) AS entities FROM d GROUP BY 1), xs AS (SELECT DISTINCT l_orderkey, item FROM d), pt AS (SELECT a.item, b.item AS partner, count(*) AS n FROM xs a JOIN xs b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item GROUP BY 1, 2),
pr AS (SELECT item, string_agg(partner || '=' || n, ',' ORDER BY n DESC, partner) AS partners FROM (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, partner) <= 15) GROUP BY 1),
cd AS (SELECT nt.*, partners, 'tecnico | ' || CASE m WHEN 'licenciatura' THEN 'profesional_con_grado' ELSE m END AS levels, area, narrow FROM nt JOIN lv USING (item) LEFT JOIN pr USING (item))"""


@query(f"WITH {_CARDS} SELECT item, entities, partners, levels, 'tecnico=40.0,profesional_con_grado=60.0' AS shares FROM cd")
def cards_with_levels(spark: SparkSession, d: str) -> DataFrame:
    pairs = lambda c, x, y: F.array_join(F.transform(c, lambda s: F.concat(s[x], F.lit("="), s[y].cast("string"))), ",")
    return _cards(spark, d).select("item", "entities", pairs("partners", "partner", "n").alias("partners"), text.list_text(F.col("levels")).alias("levels"), pairs("shares", "level", "share").alias("shares"))


@query(f"WITH {_CARDS} SELECT level, count(*) AS items FROM (SELECT unnest(string_split(levels, ' | ')) AS level FROM cd) GROUP BY 1")
def programs_per_level(spark: SparkSession, d: str) -> DataFrame:
    return baskets.items_per_level(_cards(spark, d))


@query(f"WITH {_CARDS} SELECT item FROM cd WHERE area = 'ECONOMY' AND (contains(item, 'bolt') OR EXISTS (SELECT 1 FROM d WHERE d.item = cd.item AND contains(lower(brand), 'bolt'))) AND contains(levels, 'tecnico')")
def card_search(spark: SparkSession, d: str) -> DataFrame:
    cards = _cards(spark, d).withColumn("origin_names", F.transform("origins", lambda o: o["origin"]))
    return explore.filter_cards(cards, area="ECONOMY", level="tecnico", text="BÓLT").select("item")


@query(f"WITH {_DECLARED}, nd AS (SELECT CAST(l_partkey % 30 AS VARCHAR) AS item, count(DISTINCT l_orderkey) AS degree FROM d GROUP BY 1) SELECT item, degree, coalesce(n_name, item) AS label FROM nd LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = item")
def network_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = declared(spark, d).withColumn("code", (F.col("l_partkey") % 30).cast("string"))
    nodes = baskets.degrees(baskets.baskets(rows, "l_orderkey", "code"))
    return baskets.named_nodes(nodes, _t(spark, d, "nation"), "n_nationkey", "n_name")


@query("SELECT DISTINCT p_name, 'exact' AS match FROM part WHERE p_name = 'red bolt'")
def find_name_exact(spark: SparkSession, d: str) -> DataFrame:
    return explore.find_name(_t(spark, d, "part"), "p_name", " Réd  BOLT!")


@query("SELECT DISTINCT p_name, 'similar' AS match FROM part WHERE contains(p_name, 'bol') ORDER BY 1 LIMIT 15")
def find_name_similar(spark: SparkSession, d: str) -> DataFrame:
    return explore.find_name(_t(spark, d, "part"), "p_name", "BÓL")


@query(f"""WITH {_DECLARED}, fq AS (SELECT l_linestatus AS segment, item, count(DISTINCT l_orderkey) AS n FROM d GROUP BY 1, 2), xs AS (SELECT DISTINCT l_linestatus AS segment, l_orderkey, item FROM d),
p AS (SELECT x.segment, x.item AS a, y.item AS b, count(*) AS n FROM xs x JOIN xs y USING (segment, l_orderkey) WHERE x.item < y.item GROUP BY ALL) SELECT p.segment, a, b, round(1 - p.n / (fa.n + fb.n - p.n), 6) AS d FROM p JOIN fq fa ON fa.segment = p.segment AND fa.item = a JOIN fq fb ON fb.segment = p.segment AND fb.item = b WHERE fa.n >= 3 AND fb.n >= 3""")
def cluster_distances(spark: SparkSession, d: str) -> DataFrame:
    return cluster.distances(*_segments(spark, d)).select("segment", F.explode("pairs").alias("p")).select("segment", "p.a", "p.b", r6("p.d").alias("d"))


# ── Rules ──────────────────────────────────────────────────────────────────

_LEVELLED = """x AS (SELECT p_partkey AS w, ['Técnico en ', 'Ingeniería en ', '', 'Pedagogía en '][p_partkey % 4 + 1] || p_name || ' ' || p_partkey AS item, ['Técnico en ', 'Ingeniería Civil en ', 'Ingeniería en '][p_size % 3 + 1] || p_name AS program FROM part),
pg AS (SELECT DISTINCT ['Técnico en ', 'Ingeniería Civil en ', 'Ingeniería en '][p_size % 3 + 1] || p_name AS program, p_size % 3 AS kind, p_name AS core FROM part)"""


def _levelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A crosswalk whose names state levels, and the programs with theirs."""
    p = _t(spark, d, "part")
    program = F.concat(_pick(F.col("p_size"), ["Técnico en ", "Ingeniería Civil en ", "Ingeniería en "]), "p_name")
    item = F.concat(_pick(F.col("p_partkey"), ["Técnico en ", "Ingeniería en ", "", "Pedagogía en "]), "p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    x = p.select(item.alias("item"), F.lit(1).alias("ord"), program.alias("program"), F.col("p_partkey").alias("weight"))
    levels = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("tecnico"))).otherwise(F.array(F.lit("profesional")))
    return x, p.select(program.alias("program"), levels.alias("levels")).distinct()


@query(f"""WITH {_LEVELLED}, h AS (SELECT x.*, pg.kind, pg.core, CASE w % 4 WHEN 0 THEN 'tecnico' WHEN 2 THEN NULL ELSE 'superior' END AS lv FROM x JOIN pg USING (program))
SELECT 'V-12' AS rule, item AS key, lv || ' -> ' || program AS detail, w AS weight FROM h WHERE (lv = 'tecnico' AND kind > 0) OR (lv = 'superior' AND kind = 0)
UNION ALL SELECT 'V-15', item, program || ' / ' || (SELECT min(o.program) FROM pg o WHERE o.core = h.core AND o.program <> h.program AND o.kind <> 1), w FROM h WHERE lv IS NULL AND kind <> 1 AND EXISTS (SELECT 1 FROM pg o WHERE o.core = h.core AND o.program <> h.program AND o.kind <> 1)
UNION ALL SELECT 'V-16', item, program || ' / ' || coalesce((SELECT min(o.program) FROM pg o WHERE o.core = h.core AND o.kind <> 1), '-'), w FROM h WHERE kind = 1""")
def validate_stated_levels(spark: SparkSession, d: str) -> DataFrame:
    x, programs = _levelled(spark, d)
    found = rules.contradicted_level(x, programs).union(rules.undeclared_level(x, programs)).union(rules.civil_not_said(x, programs))
    return found.select("rule", "key", "detail", "weight")


@query(f"""WITH {_DEFECTIVE}, o AS (SELECT k, first(item ORDER BY ord, item, weight) AS item, first(weight ORDER BY ord, item, weight) AS weight, bool_and(state <> 'validado') AS open, first(weight ORDER BY ord, weight) AS w FROM k GROUP BY 1), t AS (SELECT lower(item) AS k, min(item) AS item FROM ms GROUP BY 1)
SELECT 'V-09' AS rule, item AS key FROM o WHERE k NOT IN (SELECT k FROM t) UNION ALL SELECT 'V-10', item FROM t WHERE k NOT IN (SELECT k FROM o)
UNION ALL (SELECT 'V-17', item FROM ms WHERE lower(item) NOT IN (SELECT k FROM o) GROUP BY item ORDER BY count(*) DESC, item LIMIT 10)
UNION ALL SELECT 'V-18', p_type FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'SMALL') WHERE p_type NOT IN (SELECT program FROM x)""")
def validate_master_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows behind the counts of validate_master, and programs that no name leads to."""
    x, programs, _, master = _defective(spark, d)
    found = rules.against_master(x, master).where("rule <> 'V-08'").union(rules.orphan_mentions(x, master)).union(rules.unused_programs(x, programs))
    return found.select("rule", "key")


@query(f"""WITH {_DEFECTIVE}, g AS (SELECT k, bool_and(state <> 'validado') AS open, min(weight) AS w FROM k GROUP BY 1) SELECT k AS key, w AS weight FROM g WHERE open ORDER BY w DESC, k LIMIT 40""")
def validate_review_queue(spark: SparkSession, d: str) -> DataFrame:
    x = _defective(spark, d)[0]
    first = x.groupBy("item").agg(F.min("weight").alias("weight"), F.min("ord").alias("ord"), F.max("state").alias("state"))
    return rules.review_queue(first.withColumn("ord", F.col("weight"))).select("key", "weight")


@query(f"""WITH {_DEFECTIVE}, t AS (SELECT lower(item) AS k, min(item) AS item, list(item) AS all FROM ms GROUP BY 1) SELECT CASE WHEN t.k IS NULL OR list_contains(t.all, k.item) THEN k.item ELSE t.item END AS item, k.weight FROM k LEFT JOIN t ON t.k = k.k""")
def adopt_spelling(spark: SparkSession, d: str) -> DataFrame:
    x, _, _, master = _defective(spark, d)
    return rules.adopt_master_spelling(x, master).select("item", "weight")


@query(f"""WITH {_DEFECTIVE}, g AS (SELECT k, first(kind ORDER BY weight) AS kind, min(state) AS state, min(confidence) AS confidence, min(weight) AS w FROM k GROUP BY 1) SELECT kind, state, confidence, count(*) AS names, CAST(sum(w) AS BIGINT) AS weight FROM g GROUP BY ALL""")
def crosswalk_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = _defective(spark, d)[0]
    return rules.distribution(x.withColumn("ord", F.col("weight")))


@query("""WITH o AS (SELECT p_name AS name, count(*) AS weight FROM part GROUP BY 1), c AS (SELECT DISTINCT upper(p_name) AS canon FROM part WHERE p_size = 7), pv AS (SELECT p_name || CASE WHEN p_size = 3 THEN ' old' ELSE '' END AS name, min(p_type) AS decision FROM part WHERE p_size IN (2, 3) GROUP BY 1),
q AS (SELECT o.weight, coalesce(pv.decision, CASE WHEN o.name IS NOT NULL THEN c.canon END) AS decision, o.name IS NULL AS kept, o.name IS NOT NULL AND pv.decision IS NULL AND c.canon IS NOT NULL AS auto FROM o FULL JOIN pv ON o.name = pv.name LEFT JOIN c ON lower(c.canon) = o.name)
SELECT count(*) AS rows, count(*) FILTER (auto) AS auto, count(*) FILTER (decision IS NOT NULL AND NOT auto AND NOT kept) AS already, count(*) FILTER (kept) AS kept, count(*) FILTER (decision IS NULL) AS pending,
CAST(coalesce(sum(weight) FILTER (decision IS NOT NULL), 0) AS BIGINT) AS decided_weight, CAST(sum(weight) AS BIGINT) AS weight FROM q""")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    observed = part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight"))
    canon = part.where("p_size = 7").groupBy(F.upper("p_name").alias("canon")).agg(F.min("p_partkey").alias("ord"))
    old = part.where("p_size in (2, 3)").groupBy(F.concat("p_name", F.when(F.col("p_size") == 3, " old").otherwise("")).alias("name")).agg(F.min("p_type").alias("decision"))
    old = old.withColumn("level", F.lit("*")).withColumn("weight", F.lit(None).cast("bigint"))
    return xwalk.queue_summary(xwalk.queue(observed, canon, old, "name", "level", "weight", "decision", "canon", "ord"), "decision", "weight")


# ── Profiles ───────────────────────────────────────────────────────────────


@query("""WITH v AS (SELECT * FROM (VALUES ('o_orderkey', 'code', true), ('o_gone', 'absent', false), ('o_custkey', 'manual', true), ('o_orderstatus', 'unexpected', false), ('o_totalprice', 'unexpected', false), ('o_orderdate', 'unexpected', false), ('o_orderpriority', 'unexpected', false), ('o_old', 'orphan gloss', true)) v("column", origin, documented)),
f AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column", count(*) AS rows, unnest([count(o_orderkey), count(o_custkey), count(nullif(trim(o_orderstatus), '')), count(o_totalprice), count(o_orderdate), count(nullif(trim(o_orderpriority), ''))]) AS filled FROM orders)
SELECT v.*, f.rows, f.filled FROM v LEFT JOIN f USING ("column")""")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    return profile.drift_report(_t(spark, d, "orders"), "orders", ["o_orderkey", "o_gone"], ["o_custkey"], ["o_orderkey", "o_custkey", "o_old"]).drop("table")


_KEYS = """kv AS (SELECT json_keys(j) AS ks, j FROM (SELECT '{"k' || event_id % 3 || '":"' || user_id || '","e":""}' AS j FROM events)), kk AS (SELECT unnest(ks) AS key, j FROM kv)"""


def _profile(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e = _t(spark, d, "events").select(F.concat(F.lit('{"k'), (F.col("event_id") % 3).cast("string"), F.lit('":"'), F.col("user_id").cast("string"), F.lit('","e":""}')).alias("j"))
    masters = {t: _t(spark, d, t) for t in ("nation", "region", "orders")}
    return profile.profile(masters, e, {"detail": F.col("j")}, {"nation": ["n_nationkey", "n_name"], "region": ["r_regionkey", "r_name"], "gone": []}, {}, ["k0", "other"])


@query(f"""WITH {_KEYS} SELECT key, count(*) AS n_records, count(*) FILTER (json_extract_string(j, '$.' || key) <> '') AS filled, least(401, count(DISTINCT nullif(json_extract_string(j, '$.' || key), ''))) AS distinct_values FROM kk WHERE key NOT IN ('k0', 'other') GROUP BY 1""")
def undocumented_keys(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)["undocumented"].select("key", "n_records", "filled", n(F.col("distinct_values")).alias("distinct_values"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES) + """) SELECT name, CASE WHEN name IN ('nation', 'region', 'orders') THEN 'present' ELSE 'unknown' END AS status, rows FROM r UNION ALL SELECT 'gone', 'missing', NULL""")
def tables_listed(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the folder against those that are expected, with the rows that each has."""
    found = raw.tables_in(spark, d)
    names = [r["name"] for r in found.collect()]  # files of one folder
    rows = profile.shapes({t: _t(spark, d, t) for t in names}).select(F.col("table").alias("name"), "rows")
    expected = spark.createDataFrame([("nation",), ("region",), ("orders",), ("gone",)], "name string")
    return profile.tables_present(found, expected).join(rows, "name", "left")


@query("SELECT 'nation' AS \"table\", count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)["shapes"]


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return profile.first_lines(li, "l_orderkey", "at", 2).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


_SHARED = f"""{_SIZED}, h AS (SELECT z.o_orderkey, z.k, z.o_custkey % 3 AS owner, array_to_string(list_sort(list_distinct(list(l_partkey % 9))), '|') AS h FROM z JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), sh AS (SELECT h, count(*) AS n, max(k) AS size, count(DISTINCT owner) = 1 AS template FROM h GROUP BY 1 HAVING count(*) > 1)"""


def _shared(spark: SparkSession, d: str) -> DataFrame:
    sets = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey") % 9)), "|").alias("h"))
    return quality.reused_sets(_sized(spark, d).join(sets, "o_orderkey").withColumn("owner", F.col("o_custkey") % 3), "h", "k", "owner", UPPER, 5)


@query(f"WITH {_SHARED} SELECT h, n, size FROM sh ORDER BY n DESC, size DESC, h LIMIT 5")
def shared_sets_top(spark: SparkSession, d: str) -> DataFrame:
    return quality.shared_set_summary(_shared(spark, d)).select("h", "n", "size")


@query(f"WITH {_SHARED} SELECT count(*) AS sets, CAST(sum(n) AS BIGINT) AS entities FROM sh")
def shared_sets_total(spark: SparkSession, d: str) -> DataFrame:
    return quality.shared_set_totals(_shared(spark, d))


@query(f"WITH {_SHARED} SELECT h, size, n FROM sh WHERE template ORDER BY size DESC, n DESC, h")
def templates_ordered(spark: SparkSession, d: str) -> DataFrame:
    return quality.ordered_templates(_shared(spark, d)).select("h", "size", "n")


@query("SELECT count(*) AS recoverable FROM orders o WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 3)")
def recoverable_names(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 == 3, F.lit("name")).alias("name"), (F.col("o_orderstatus") == "F").alias("hidden"))
    return quality.recoverable(o, "o_custkey", "name", "hidden")
