import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars as sc
from palimpsest.functions import stats, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_normal_forms(spark):
    r = one(
        spark,
        a=text.normalise(F.lit("  Ingeniería  CIVIL, en Minas! ")), b=text.normalise(F.lit(None).cast("string")), c=text.fold(F.lit("Música,  Ñandú")), d=text.join_key(F.lit(" Música  Y  Arte ")),
        e=text.slug(F.lit("Área de Salud!")), f=text.slugify(F.lit(7), F.lit("***")), g=text.slugify(F.lit(7), F.lit("Jefe de Área")), h=text.normalise(F.lit("éte")),
    )
    assert r.asDict() == {"a": "ingenieria civil en minas", "b": "", "c": "musica, nandu", "d": "música y arte", "e": "area_de_salud", "f": None, "g": "7-jefe-de-area", "h": "ete"}


def test_join_key_keeps_accents(spark):
    r = one(spark, a=text.join_key(F.lit("Ingeniería Civil  ")) == text.join_key(F.lit("ingeniería  civil")), b=text.join_key(F.lit("Música")) == text.join_key(F.lit("Musica")))
    assert (r.a, r.b) == (True, False)


def test_html(spark):
    r = one(spark, a=text.strip_html(F.lit("<SCRIPT x>a<b</script>uno<br/>dos</p><b>tr</b>es &amp;lt; &nbsp;")), b=text.strip_html(F.lit("<p></p>")))
    assert (r.a, r.b) == ("uno dos tres <", None)


def test_hashes(spark):
    r = one(
        spark,
        a=text.set_hash(F.array(F.lit("Música"), F.lit("Arte"))), b=text.set_hash(F.array(F.lit("arte"), F.lit("MUSICA"))), c=text.set_hash(F.array().cast("array<string>")),
        d=text.content_hash(F.lit(None).cast("long"), F.lit("x"), F.lit(None).cast("string")),
    )
    assert r.a == r.b and r.c is None and len(r.d) == 16


def test_derived_categories(spark):
    r = one(spark, a=text.work_mode(F.lit("Jornada Híbrida")), b=text.work_mode(F.lit("Completa")), c=text.work_mode(F.lit("")), d=text.contract_type(F.lit("Práctica profesional")), e=text.work_mode(F.lit("Remoto / mixta")))
    assert tuple(r) == ("Híbrido", "No informado", None, "Práctica", "Híbrido")


def test_tokens(spark):
    t = lambda s: text.tokens(F.lit(s), 3)
    r = one(spark, a=text.all_tokens_match(t("ingeniería naval"), t("ingeniería civil")), b=text.all_tokens_match(t("naval"), t("navales y más")), c=text.all_tokens_match(t("de"), t("todo")))
    assert tuple(r) == (False, True, False)


def test_levels(spark):
    r = one(
        spark,
        a=text.level_list(F.lit("licenciatura | otro | tecnico | profesional_con_grado"), ["tecnico", "profesional_con_grado"]),
        b=F.transform(text.level_shares(F.lit("profesional_con_grado 30.5% | licenciatura 9.5% | x | tecnico y%")), lambda s: F.concat(s["level"], F.lit("="), s["share"].cast("string"))),
        c=text.level_of_name(F.lit("Técnico en X")), d=text.level_of_name(F.lit("Ingeniería")), e=text.level_of_name(F.lit("Dibujo e Ingeniería")), f=text.core_name(F.lit("Ingeniería Civil en Minas")),
    )
    assert r.a == ["tecnico", "profesional_con_grado", "otro"] and r.b == ["profesional_con_grado=40.0"]
    assert (r.c, r.d, r.e, r.f) == ("tecnico", "superior", None, "minas")


def test_scalars(spark):
    s = lambda x: F.lit(x).cast("string")
    r = one(
        spark,
        a=sc.date_iso(s("12/08/2026")), b=sc.date_iso(s("2026-08-12 12:10")), c=sc.date_iso(s("2026-13-01")), d=sc.date_iso(s("x")), e=sc.int_or(s("945.0")), f=sc.int_or(s("945.0"), via_float=True), g=sc.int_or(s(" 7 ")), h=sc.int_or(s(None), 3),
    )
    assert [str(x) for x in r] == ["2026-08-12", "2026-08-12", "None", "None", "0", "945", "7", "3"]
    r = one(
        spark,
        a=sc.experience(s("Sin experiencia"), F.lit(2.0)), b=sc.experience(s(None), F.lit(None).cast("double")), c=sc.coordinates(F.lit(None).cast("array<double>"), s("-23.6, -70.4")), d=sc.coordinates(F.array(F.lit(1.0), F.lit(2.0)), s("9,9")),
        e=sc.place(s(None), s(""), s("Comuna, Región")), f=sc.shown_salary(F.lit(5.0), F.lit(None).cast("boolean")), g=sc.is_confidential(F.lit(False), F.lit(None).cast("boolean"), s("Empresa  CONFIDENCIAL")), h=sc.code_levels(s("071")),
    )
    assert (r.a.inconsistent, r.b.inconsistent, tuple(r.c), tuple(r.d), tuple(r.e), r.f, r.g, tuple(r.h)) == (True, None, (-23.6, -70.4), (1.0, 2.0), ("Región", "Comuna"), None, True, ("07", "071", None))


def exact_fisher(a, b, c, d):
    n, row, col = a + b + c + d, a + b, a + c
    return min(1.0, sum(math.comb(row, x) * math.comb(n - row, col - x) for x in range(a, min(row, col) + 1)) / math.comb(n, col)) if a else 1.0


def test_fisher(spark):
    rng = random.Random(1)
    tables = [(3, 0, 0, 3), (0, 2, 2, 1), *((rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 400)) for _ in range(200))]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    for r in df.select("*", stats.fisher_right(*(F.col(x) for x in "abcd")).alias("p")).collect():
        assert r.p == pytest.approx(exact_fisher(*r[:4]), rel=1e-9)


def test_benjamini_hochberg(spark):
    rng = random.Random(2)
    for p in ([0.01, 0.02, 0.03, 0.04], [round(rng.random() ** 3, 3) for _ in range(12_500)]):
        got = sorted((r.p, r.q) for r in stats.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double")).collect())
        order, least, want = sorted(p), 1.0, []
        for rank in range(len(p), 0, -1):
            least = min(least, order[rank - 1] * len(p) / rank)
            want.append(least)
        assert [x for x, _ in got] == order
        assert [q for _, q in got] == pytest.approx(want[::-1])
    assert stats.benjamini_hochberg(spark.createDataFrame([], "p double")).count() == 0


def test_adjusted_rand(spark):
    rows = [(i, g, (g * 7 + i) % 3) for i, g in enumerate(itertools.islice(itertools.cycle([0, 1, 1, 2]), 40))]
    df = spark.createDataFrame(rows, "i long, a long, b long")
    assert stats.adjusted_rand(df, "a", "a").first().ari == pytest.approx(1.0)
    assert math.isnan(stats.adjusted_rand(df.withColumn("o", F.lit(1)).withColumn("z", F.lit(1)), "o", "z").first().ari)


def test_most_rows_with_one_p_fill_no_task(spark):
    """40,000 rows, of which 90 % have p = 1 and a few none: shuffled over 8 partitions, none gets more than a third."""
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 50 == 1, F.lit(None)).when(F.col("id") % 10 == 0, (F.col("id") + 1) / 40_000).otherwise(1.0).alias("p"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        out = stats.benjamini_hochberg(rows).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    p = sorted(r.p for r in out if r.p is not None)
    least, q = 1.0, {}
    for k in range(len(p), 0, -1):
        least = min(least, p[k - 1] * len(p) / k)
        q[p[k - 1]] = min(least, q.get(p[k - 1], 1.0))
    assert len(out) == 40_000 and all(r.q is None if r.p is None else abs(r.q - q[r.p]) < 1e-12 for r in out)
    assert max(Counter(r.at for r in out).values()) < 40_000 / 3
