"""Raw observations to master tables: one fold per entity, bridges, crosswalk attribution, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scalars as sc
from palimpsest.functions import text as tx
from palimpsest.operators import bridges, dims, panel, xwalk
from palimpsest.sources.schemas import MANAGED, MANUAL

DOWN = "DESACTIVADA"


def _full(c):
    return F.nullif(c, F.lit(""))


def flatten(raw: DataFrame, url_prefix: str = "") -> DataFrame:
    """One row per observation with the master's content columns (detail first, then listing) and the arrays that bridges need. url_prefix: the site's address, before an entity's own part."""
    d, l = "detalle", "listado"
    col = lambda p: F.col(p)
    either = lambda a, b: F.coalesce(_full(col(f"{d}.{a}")), _full(col(f"{l}.{b}")))
    has = col(d).isNotNull()
    name = F.trim(F.coalesce(_full(col(f"{d}.nombreEmpresaFantasia")), _full(col(f"{l}.nombreEmpresa")), F.lit("")))
    hidden = sc.is_confidential(has, col(f"{d}.ofertaConfidencial"), name)
    title = either("nombreCargo", "nombreCargo")
    published = sc.date_iso(either("fechaPublicacionFormatoIngles", "fechaPublicacion"))
    expires = sc.date_iso(col(f"{d}.fechaExpiracionFormatoIngles"))
    schedule = either("nombreJornada", "nombreJornada")
    at = sc.coordinates(col(f"{d}.ubicacion.coordenadas.coordinates"), col(f"{l}.geolocalizacion"))
    where = sc.place(col(f"{d}.ubicacion.nombreRegion"), col(f"{d}.ubicacion.nombreComuna"), col(f"{l}.ubicacion"))
    known = sc.experience(col(f"{d}.nombreOperadorExperiencia"), col(f"{d}.aniosExperiencia"))
    text = tx.strip_html(either("descripcionOferta", "descripcionOferta"))
    size = lambda a: F.greatest(F.coalesce(F.size(f"{d}.{a}"), F.lit(0)), F.lit(0))
    names = F.filter(F.transform(f"{d}.carreras", lambda c: c["nombreCarrera"]), lambda n: n.isNotNull() & (n != ""))
    return raw.where(F.col("aviso_id").isNotNull()).select(
        "aviso_id",
        "ord",
        tx.public_url(url_prefix, col(f"{d}.slug"), col("aviso_id"), title).alias("url"),
        title.alias("titulo"),
        text.alias("descripcion"),
        tx.strip_html(col(f"{d}.requisitosMinimos")).alias("requisitos"),
        tx.content_hash(col(f"{d}.idCompany"), title, text).alias("hash_contenido"),
        col(f"{d}.idCompany").alias("empresa_id"),
        col(f"{d}.idEmpresa").alias("empresa_id_alt"),
        F.when(~hidden, _full(name)).alias("empresa_nombre"),
        hidden.alias("empresa_confidencial"),
        published.alias("fecha_publicacion"),
        expires.alias("fecha_expiracion"),
        sc.days_between(published, expires).alias("vigencia_declarada_dias"),
        col(f"{d}.nombreTipoCargo").alias("tipo_cargo"),
        col(f"{d}.nombreArea").alias("area_funcional"),
        col(f"{d}.cantidadVacantes").alias("vacantes"),
        where["region"].alias("region"),
        where["town"].alias("comuna"),
        col(f"{d}.ubicacion.direccion").alias("direccion"),
        col(f"{d}.ubicacion.codigoPostal").alias("codigo_postal"),
        at["lat"].alias("latitud"),
        at["lon"].alias("longitud"),
        schedule.alias("jornada"),
        tx.work_mode(schedule).alias("modalidad"),
        tx.contract_type(schedule).alias("tipo_contrato"),
        sc.shown_salary(col(f"{d}.sueldo"), col(f"{d}.mostrarSueldo")).alias("sueldo_liquido"),
        col(f"{d}.mostrarSueldo").alias("muestra_sueldo"),
        col(f"{d}.nombreMoneda").alias("moneda"),
        known["operator"].alias("exp_operador"),
        known["years"].alias("exp_anios"),
        known["inconsistent"].alias("exp_inconsistente"),
        col(f"{d}.nombreNivelAcademico").alias("nivel_academico"),
        col(f"{d}.nombreSituacionAcademica").alias("situacion_academica"),
        size("carreras").alias("n_entradas_declaradas"),
        size("habilidades").alias("n_habilidades"),
        size("instituciones").alias("n_instituciones"),
        tx.set_hash(F.coalesce(names, F.array().cast("array<string>"))).alias("hash_entradas"),
        col(f"{d}.candidadPostulaciones").alias("postulaciones"),
        col(f"{d}.candidadVisualizaciones").alias("visualizaciones"),
        col(f"{l}.ofertaDestacada").alias("destacada"),
        col(f"{l}.ofertaInclusiva").alias("inclusiva"),
        col(f"{d}.tipoCurriculumAceptado").alias("tipo_curriculum"),
        col(f"{d}.usaScoreScreening").alias("usa_score_screening"),
        "detalle_ok",
        "detalle_motivo",
        col(f"{d}.estadoOferta").alias("_estado"),
        F.to_date("fecha_scraping").alias("_fecha"),
        F.col("periodo").alias("_periodo"),
        F.col("area_scraping").alias("_area"),
        F.coalesce("terminos", F.array().cast("array<string>")).alias("_terminos"),
        F.coalesce(names, F.array().cast("array<string>")).alias("_carreras"),
        F.coalesce(f"{d}.habilidades", F.array().cast(raw.schema[d].dataType["habilidades"].dataType)).alias("_habilidades"),
        F.coalesce(f"{d}.instituciones", F.array().cast(raw.schema[d].dataType["instituciones"].dataType)).alias("_instituciones"),
    )


_SETS = {"periodos_visto": "_periodo", "areas_scraping": "_area"}


def panel_states(obs: DataFrame) -> DataFrame:
    """Mergeable panel state per entity."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    sets = {n: one(c) for n, c in _SETS.items()} | {"terminos_busqueda": F.col("_terminos")}
    return panel.partial_panel(obs, "aviso_id", "_fecha", F.col("ord"), "_estado", DOWN, sets)


def avisos(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The entity table: panel columns over all observations, content of the last one."""
    states = panel.finish_panel(panel_states(obs), DOWN).drop("days_until_down", "censored")
    content = panel.latest(obs.drop("_estado", "_fecha", "_periodo", "_area", "_terminos", "_carreras", "_habilidades", "_instituciones"), ["aviso_id"], F.col("ord")).drop("ord")
    content = panel.with_multiplicity(content, "hash_entradas", "n_avisos_mismo_conjunto")  # as many rows as states, and less to go over twice
    mapped = xwalk.map_terms(states.select("aviso_id", F.explode_outer("terminos_busqueda").alias("term")).where("term is not null"), catalog, "term")
    by_term = mapped.groupBy("aviso_id").agg(
        F.array_sort(F.collect_set("name")).alias("sies_por_termino"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("areas")))).alias("areas_sies_por_termino"), F.count_if(~F.col("mapped")).cast("int").alias("n_terminos_sin_mapeo")
    )
    rows = states.join(content, "aviso_id").join(by_term, "aviso_id", "left")
    rows = (
        rows.withColumnsRenamed({"first_seen": "primera_vez_visto", "last_seen": "ultima_vez_visto", "n_seen": "n_corridas_visto", "first_state": "estado_primero", "last_state": "estado_ultimo", "down_on": "fecha_desactivacion_detectada", "duration_quality": "calidad_duracion"})
        .withColumn("n_terminos_busqueda", F.size("terminos_busqueda"))
        .withColumn("dias_publicado_hasta_baja", sc.days_between(F.col("fecha_publicacion"), F.col("fecha_desactivacion_detectada")))
        .withColumn("censurado", F.col("fecha_desactivacion_detectada").isNull())
        .withColumn("sies_por_termino", F.coalesce("sies_por_termino", F.array().cast("array<string>")))
        .withColumn("areas_sies_por_termino", F.coalesce("areas_sies_por_termino", F.array().cast("array<string>")))
        .withColumn("n_sies_por_termino", F.size("sies_por_termino"))
        .withColumn("n_terminos_sin_mapeo", F.coalesce("n_terminos_sin_mapeo", F.lit(0)))
    )
    return rows.select(*MANAGED["avisos"])


def consolidate(raw: DataFrame, catalog: DataFrame, crosswalk: DataFrame, programs: DataFrame, codes: DataFrame, previous: dict[str, DataFrame] | None = None, upper: int = 30, url_prefix: str = "") -> dict[str, DataFrame]:
    """All master tables. catalog: area, term, name, ordinal; crosswalk: item, program, code, kind; programs, codes: see xwalk.attribution."""
    previous, key, ord = previous or {}, "aviso_id", F.col("ord")
    obs = flatten(raw, url_prefix)
    masters = {"avisos": avisos(obs, catalog)}
    declared = bridges.declared_and_keyword(obs, key, F.col("_carreras"), F.col("_terminos"), F.col("detalle_ok"), ord)
    masters["aviso_entrada"] = declared.select(key, F.col("item").alias("entrada_trabajando"), F.col("term").alias("termino_busqueda"), F.col("source").alias("fuente"), F.col("n_declared").alias("n_entradas_declaradas_aviso"))
    terms = obs.select(key, F.explode("_terminos").alias("termino_busqueda")).where("termino_busqueda is not null").distinct()
    masters["aviso_termino"] = xwalk.map_terms(terms, catalog, "termino_busqueda").select(key, "termino_busqueda", F.col("name").alias("carrera_sies"), F.coalesce("areas", F.array().cast("array<string>")).alias("areas_sies"), F.col("mapped").alias("mapeado"))
    masters["aviso_habilidad"] = bridges.bridge(obs, key, F.col("_habilidades"), ord, {"habilidad": F.col("item.nombreHabilidad"), "nivel": _full(F.col("item.nombreNivel"))})
    masters["aviso_institucion"] = bridges.bridge(obs, key, F.col("_instituciones"), ord, {"id_institucion": F.col("item.idInstitucion")}, carried=["n_entradas_declaradas"]).withColumnRenamed("n_entradas_declaradas", "n_entradas_declaradas_aviso")
    given = masters["aviso_entrada"].where("fuente = 'declarada'")
    rows = xwalk.attribution(given.select(key, "entrada_trabajando"), crosswalk, programs, codes, key, "entrada_trabajando")
    counts = given.groupBy(key).agg(F.max("n_entradas_declaradas_aviso").alias("n_entradas_declaradas_aviso"))
    masters["aviso_programa"] = rows.join(counts, key, "left").select(
        key, F.col("kind").alias("tipo_entrada"), F.col("program").alias("programa_propio"), F.col("area").alias("area_sies"), F.col("broad").alias("isced_amplio_cod"), F.col("narrow").alias("isced_estrecho_cod"),
        F.col("detailed").alias("isced_detallado_cod"), F.size("origins").alias("n_entradas_origen"), F.col("origins").alias("entradas_origen"), F.col("ambiguous").alias("atribucion_multiple"), "n_entradas_declaradas_aviso",
    )
    items = obs.select(key, "_fecha", "_area", F.explode("_carreras").alias("entrada_trabajando"))
    masters["entradas_trabajando"] = dims.item_dim(given, items, key, "entrada_trabajando", "n_entradas_declaradas_aviso", "_fecha", "_area", upper).select(
        "entrada_trabajando", F.col("n_all").alias("n_avisos_acum"), F.col("n_specific").alias("n_avisos_especificos"), F.col("first_seen").alias("primera_vez_visto"), F.col("last_seen").alias("ultima_vez_visto"), F.col("areas").alias("areas_observadas")
    )
    places = obs.select(key, "_fecha", "_area", "ord", F.explode("_instituciones").alias("i")).select(key, "_fecha", "_area", "ord", F.col("i.idInstitucion").alias("id_institucion"), F.col("i.idInstitucionSqlServer").alias("id_institucion_alt"), F.col("i.nombreInstitucion").alias("nombre")).where("id_institucion is not null")
    numbers = dims.item_dim(masters["aviso_institucion"], places, key, "id_institucion", "n_entradas_declaradas_aviso", "_fecha", "_area", upper)
    masters["instituciones"] = dims.first_of(places, "id_institucion", ["id_institucion_alt", "nombre"], ord).join(numbers, "id_institucion").select(
        "id_institucion", "id_institucion_alt", "nombre", F.col("n_all").alias("n_avisos"), F.col("n_specific").alias("n_avisos_especificos"), F.col("first_seen").alias("primera_vez_visto"), F.col("last_seen").alias("ultima_vez_visto")
    )
    last = panel.latest(obs.select(key, "empresa_id", "empresa_confidencial", "ord"), [key], ord)  # these columns of the entity table, without the others' work
    companies = dims.company_dim(obs, last, key, "empresa_id", "_fecha", "_area", "empresa_confidencial")
    names = dims.canonical_names(obs.where("empresa_id is not null"), "empresa_id", "empresa_nombre", ord, ~F.col("empresa_confidencial"))
    masters["empresas"] = companies.join(names, "empresa_id", "left").select(
        "empresa_id", F.col("canonical_name").alias("empresa_nombre"), F.to_json("names").alias("nombres_observados"), F.col("canonical_name").isNull().alias("siempre_confidencial"), F.col("n_entities").alias("n_avisos"),
        F.col("n_confidential").alias("n_avisos_confidenciales"), F.col("first_seen").alias("primera_vez_visto"), F.col("last_seen").alias("ultima_vez_visto"), "areas",
    )
    for name, k in MANUAL.items():
        masters[name] = dims.upsert_preserving_manual(masters[name], previous.get(name), MANAGED[name], k)
    return masters
