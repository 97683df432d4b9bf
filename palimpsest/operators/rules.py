"""Validation rules over a crosswalk: every rule is a DataFrame(severity, rule, key, detail, weight), the report their union.

Crosswalk columns: item, ord (int), kind, program, code, code_name, relation, level, state, confidence, weight.
Catalog of programs: program, levels (array). Codes: code, name. Master: item. All text columns may be null (null counts as empty).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import LEVEL_PREFIX, core_name, fold, join_key, level_of_name, normalise

#: Closed vocabularies (fixed values).
VOCABULARIES = {
    "kind": ("programa_propio", "campo_iscedf", "nivel_formativo", "solo_ocupacion", "no_informativo"),
    "relation": ("", "exacta", "equivalente", "multiple"),
    "state": ("validado", "propuesto", "pendiente", "descartado"),
    "confidence": ("alta", "media", "baja"),
    "level": ("", "tecnico", "profesional", "profesional_con_grado", "licenciatura", "posgrado_postitulo", "sin_definir"),
}
#: Kind of entry: must program, and code, be full (fixed values).
DESTINATIONS = {
    "programa_propio": (True, False),
    "campo_iscedf": (False, True),
    "nivel_formativo": (False, False),
    "solo_ocupacion": (False, False),
    "no_informativo": (False, False),
}
CIVIL = "Ingeniería Civil"
_COLUMNS = ("severity", "rule", "key", "detail", "weight")


def text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def findings(df: DataFrame, severity: str, rule: str, key: Column, detail: Column, weight: Column | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"), (F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(0)).cast("bigint").alias("weight"))


def _keyed(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.withColumn("_key", join_key(F.col("item")))


def duplicate_spellings(x: DataFrame) -> DataFrame:
    """V-01: two rows with one join key and order; the detail tells whether they agree on the destination."""
    g = _keyed(x).groupBy("_key", "ord").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item")).alias("names"), F.countDistinct(text("kind"), text("program"), text("code")).alias("goals"))
    return findings(g.where("n > 1"), "error", "V-01", F.col("_key"), F.concat(F.array_join("names", " / "), F.when(F.col("goals") == 1, ": merge").otherwise(": decide")))


def broken_order(x: DataFrame) -> DataFrame:
    """V-02: orders of a name aren't 1..n."""
    g = _keyed(x).groupBy("_key").agg(F.array_sort(F.collect_list(F.coalesce("ord", F.lit(0)))).alias("ords"), F.min_by("weight", "ord").alias("w"))
    return findings(g.where(F.col("ords").cast("array<int>") != F.sequence(F.lit(1), F.size("ords"))), "error", "V-02", F.col("_key"), F.array_join(F.col("ords").cast("array<string>"), ","), F.col("w"))


def outside_vocabulary(x: DataFrame) -> DataFrame:
    """V-03."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"), F.coalesce(F.col(c).cast("string"), F.lit("")).isin(*v).alias("ok")) for c, v in VOCABULARIES.items())))
    bad = x.select("item", "weight", each.alias("v")).where("not v.ok")
    return findings(bad, "error", "V-03", F.col("item"), F.concat("v.column", F.lit("="), "v.value"), F.col("weight"))


def incoherent_destination(x: DataFrame) -> DataFrame:
    """V-04: program or code full where the kind wants it empty, or the other way round."""
    wants = lambda i: reduce(lambda acc, kv: F.when(text("kind") == kv[0], F.lit(kv[1][i])).otherwise(acc), DESTINATIONS.items(), F.lit(None).cast("boolean"))
    rows = []
    for i, c in enumerate(("program", "code")):
        full = text(c) != ""
        bad = x.where(wants(i).isNotNull() & (wants(i) != full))
        rows.append(findings(bad, "error", "V-04", F.col("item"), F.concat(text("kind"), F.lit(f": {c} is "), F.when(full, "full").otherwise("empty")), F.col("weight")))
    return rows[0].union(rows[1])


def unknown_program(x: DataFrame, programs: DataFrame) -> DataFrame:
    """V-05."""
    bad = x.withColumn("_p", text("program")).where("_p <> ''").join(programs.select(F.col("program").alias("_p")), "_p", "left_anti")
    return findings(bad, "error", "V-05", F.col("item"), F.col("_p"), F.col("weight"))


def unknown_code(x: DataFrame, codes: DataFrame) -> DataFrame:
    """V-06."""
    bad = x.withColumn("_c", text("code")).where("_c <> ''").join(codes.select(F.col("code").alias("_c")), "_c", "left_anti")
    return findings(bad, "error", "V-06", F.col("item"), F.col("_c"), F.col("weight"))


def wrong_code_name(x: DataFrame, codes: DataFrame) -> DataFrame:
    """V-07."""
    both = x.withColumn("_c", text("code")).join(codes.select(F.col("code").alias("_c"), F.col("name").alias("_name")), "_c")
    return findings(both.where(fold(F.col("code_name")) != fold(F.col("_name"))), "error", "V-07", F.col("item"), F.concat_ws(" / ", "_c", "code_name", "_name"), F.col("weight"))


def against_master(x: DataFrame, master: DataFrame) -> DataFrame:
    """V-08 to V-10: spellings that differ only in case or spaces, names that the master lacks, names that the crosswalk lacks."""
    first = F.when(F.col("ord").isNotNull(), F.struct("ord", "item", "weight"))  # spellings of the same order: the least
    ours = _keyed(x).groupBy("_key").agg(F.min_by("item", first).alias("ours"), F.min_by("weight", first).alias("w"))
    theirs = master.where(F.col("item").isNotNull()).groupBy(join_key(F.col("item")).alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("theirs"))
    both = ours.join(theirs, "_key", "full_outer")
    cosmetic = both.where(F.col("ours").isNotNull() & F.col("theirs").isNotNull() & ~F.array_contains("theirs", F.col("ours")))
    return (
        findings(cosmetic, "review", "V-08", F.col("ours"), F.get("theirs", 0), F.col("w"))
        .union(findings(both.where("theirs is null"), "error", "V-09", F.col("ours"), F.lit("not in the master"), F.col("w")))
        .union(findings(both.where("ours is null"), "review", "V-10", F.get("theirs", 0), F.lit("not in the crosswalk")))
    )


def multiple_marks(x: DataFrame) -> DataFrame:
    """V-11: several destinations not all marked multiple, or one that is."""
    g = _keyed(x).groupBy("_key").agg(F.count("*").alias("n"), F.count_if(text("relation") == "multiple").alias("m"), F.min_by("weight", "ord").alias("w"))
    bad = g.where(((F.col("n") > 1) & (F.col("m") != F.col("n"))) | ((F.col("n") == 1) & (F.col("m") > 0)))
    return findings(bad, "error", "V-11", F.col("_key"), F.concat(F.col("m").cast("string"), F.lit(" of "), F.col("n").cast("string")), F.col("w"))


def contradicted_level(x: DataFrame, programs: DataFrame) -> DataFrame:
    """V-12: the level that the name states isn't among the program's."""
    both = x.withColumn("_p", text("program")).join(programs.select(F.col("program").alias("_p"), "levels"), "_p").withColumn("_l", level_of_name(F.col("item")))
    technical = (F.col("_l") == "tecnico") & ~F.array_contains("levels", "tecnico")
    higher = (F.col("_l") == "superior") & (F.array_distinct("levels") == F.array(F.lit("tecnico")))
    return findings(both.where(technical | higher), "review", "V-12", F.col("item"), F.concat(F.col("_l"), F.lit(" -> "), F.col("_p")), F.col("weight"))


def relation_and_program(x: DataFrame) -> DataFrame:
    """V-13."""
    bad = x.where((text("program") != "") != (text("relation") != ""))
    return findings(bad, "error", "V-13", F.col("item"), F.when(text("program") != "", "program without relation").otherwise("relation without program"), F.col("weight"))


def exact_names(x: DataFrame) -> DataFrame:
    """V-14: exacta means equal normalised names, and equal names are exacta."""
    rows = x.where(text("program") != "").withColumn("_same", normalise(F.col("item")) == normalise(F.col("program"))).withColumn("_exact", text("relation") == "exacta")
    return findings(rows.where("_same and not _exact"), "review", "V-14", F.col("item"), text("relation"), F.col("weight")).union(findings(rows.where("_exact and not _same"), "error", "V-14", F.col("item"), text("program"), F.col("weight")))


def undeclared_level(x: DataFrame, programs: DataFrame) -> DataFrame:
    """V-15: a name without a level goes to a program with one, and the catalog has the same subject at another level."""
    single = _keyed(x).groupBy("_key").agg(F.count("*").alias("n"), F.min("item").alias("item"), F.min(text("program")).alias("_p"), F.min("weight").alias("w")).where("n = 1 and _p <> ''")
    single = single.where(~fold(F.col("item")).rlike(LEVEL_PREFIX) & fold(F.col("_p")).rlike(LEVEL_PREFIX) & ~F.startswith("_p", F.lit(CIVIL))).withColumn("_core", core_name(F.col("_p")))
    others = programs.where(~F.startswith("program", F.lit(CIVIL))).select(core_name(F.col("program")).alias("_core"), F.col("program").alias("_other"))
    hit = single.join(others, "_core").where("_other <> _p").groupBy("item", "_p", "w").agg(F.min("_other").alias("_other"))
    return findings(hit, "review", "V-15", F.col("item"), F.concat_ws(" / ", "_p", "_other"), F.col("w"))


def civil_not_said(x: DataFrame, programs: DataFrame) -> DataFrame:
    """V-16."""
    bad = x.withColumn("_p", text("program")).where(F.startswith("_p", F.lit(CIVIL)) & ~fold(F.col("item")).contains("civil")).withColumn("_core", core_name(F.col("_p")))
    others = programs.where(~F.startswith("program", F.lit(CIVIL))).groupBy(core_name(F.col("program")).alias("_core")).agg(F.min("program").alias("_other"))
    return findings(bad.join(others, "_core", "left"), "review", "V-16", F.col("item"), F.concat_ws(" / ", "_p", F.coalesce("_other", F.lit("-"))), F.col("weight"))


def orphan_mentions(x: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """V-17: declared names that the crosswalk lacks, the most mentioned ones."""
    known = _keyed(x).select("_key")
    rest = mentions.withColumn("_key", join_key(F.col("item"))).join(known, "_key", "left_anti").groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)
    return findings(rest, "error", "V-17", F.col("item"), F.lit("declared, not in the crosswalk"), F.col("n"))


def unused_programs(x: DataFrame, programs: DataFrame) -> DataFrame:
    """V-18."""
    used = x.select(text("program").alias("program"))
    return findings(programs.select("program").join(used, "program", "left_anti"), "info", "V-18", F.col("program"), F.lit("no name leads here"))


def review_queue(x: DataFrame, k: int = 40) -> DataFrame:
    """V-19: names without a validated row, heaviest first."""
    g = _keyed(x).groupBy("_key").agg(F.bool_and(text("state") != "validado").alias("open"), F.min_by("weight", "ord").alias("w")).where("open").orderBy(F.desc("w"), "_key").limit(k)
    return findings(g, "info", "V-19", F.col("_key"), F.lit("not validated"), F.col("w"))


def adopt_master_spelling(x: DataFrame, master: DataFrame) -> DataFrame:
    """V-20: the crosswalk with the master's spelling where only case or spaces differ."""
    theirs = master.where(F.col("item").isNotNull()).groupBy(join_key(F.col("item")).alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("_theirs"))
    both = _keyed(x).join(theirs, "_key", "left")
    adopted = F.when(F.col("_theirs").isNotNull() & ~F.array_contains("_theirs", F.col("item")), F.get("_theirs", 0)).otherwise(F.col("item"))
    return both.withColumn("item", adopted).select(*x.columns)


def distribution(x: DataFrame) -> DataFrame:
    """Names and weight by destination type (of the first row), state and confidence (least over rows); a name counts once."""
    per = _keyed(x).groupBy("_key").agg(F.min_by(text("kind"), "ord").alias("kind"), F.min(text("state")).alias("state"), F.min(text("confidence")).alias("confidence"), F.min_by("weight", "ord").alias("w"))
    return per.groupBy("kind", "state", "confidence").agg(F.count("*").alias("names"), F.sum(F.coalesce("w", F.lit(0))).alias("weight"))


def validate(x: DataFrame, programs: DataFrame, codes: DataFrame, master: DataFrame) -> DataFrame:
    """All rules on the crosswalk, its catalogs and the master."""
    parts = [
        duplicate_spellings(x), broken_order(x), outside_vocabulary(x), incoherent_destination(x), unknown_program(x, programs), unknown_code(x, codes), wrong_code_name(x, codes), against_master(x, master),
        multiple_marks(x), contradicted_level(x, programs), relation_and_program(x), exact_names(x), undeclared_level(x, programs), civil_not_said(x, programs), orphan_mentions(x, master), unused_programs(x, programs), review_queue(x),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
