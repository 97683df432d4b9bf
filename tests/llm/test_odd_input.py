"""Every operator and every pipeline stage on odd input: clashing names, nulls, empty tables, ties, repeated and very long rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, decontamination, licenses, mixing, repeats, secret_scan, sharding, simhash_dedup, sketches, toxicity, wrapper
from tests.llm.fixtures import documents, frame, prose

#: Names of the kind that operators use inside, and of what they add.
CLASHING = (
    "_base _tokens _every _tested spans _words _checked _text _key _leak _group _rank _before _pid _mix _place _guest _late _cell _fp _kept _html _host _reference _blocks _nodes "
    "_zones _same _template _varies _hashes _grams _salt _whole _features features probability prediction rawPrediction _margin _score _toxicity row pid mix group rank before gram "
    "first last n key salt size item window label"
).split()


def labels_for(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, 1, int(i % 2)) for i in ids for _ in range(2)], "doc_id long, quality int, toxic int")


def bench(spark):
    items = [(1, prose(random.Random(99), 40)), (2, None), (3, ""), (4, "short item"), (4, "short item")]
    return spark.createDataFrame(items, "item_id long, text string")


def pages(df):
    """The texts as pages of three hosts."""
    return df.withColumn("html", F.concat(F.lit("<nav>menu</nav><p>"), F.col("text"))).withColumn("url", F.concat(F.lit("http://"), F.col("source"), F.lit("/x"))).withColumnRenamed("doc_id", "page_id")


def with_neighbours(df):
    light = df.withColumn("text", F.coalesce("text", F.lit("")))
    return sketches.with_next(sketches.with_sketch(light, "text", "sketch"), "doc_id", ["text", "sketch"], rows_per_group=5)


#: Operator: what it gives, and whether it keeps the rows and the other columns.
OPERATORS = {
    "1 scan": (lambda s, df: secret_scan.scan_secrets(df.drop("spans")), True),
    "1 redact": (lambda s, df: secret_scan.redact(df), True),
    "2 find": (lambda s, df: decontamination.find_leaks(df, bench(s).union(s.createDataFrame([(5, documents(n=12)[12][1])], "item_id long, text string"))), False),
    "2 drop": (lambda s, df: decontamination.decontaminate(df, bench(s)), True),
    "3": (lambda s, df: toxicity.fit(df, labels_for(s, documents())).score(df), True),
    "3 reject": (lambda s, df: toxicity.reject_toxic(df, labels_for(s, documents()), threshold=2.0), True),
    "4": (lambda s, df: licenses.scan_licenses(df), True),
    "5": (lambda s, df: sharding.shuffle_into_shards(df, 3), True),
    "6": (lambda s, df: wrapper.extract(pages(df).drop("text")).withColumnRenamed("page_id", "doc_id"), True),
    "7": (lambda s, df: repeats.without_repeats(df), False),
    "8": (lambda s, df: bpe.decode(bpe.encode(df)), True),
    "9": (lambda s, df: simhash_dedup.near_duplicate_components(df), False),
    "9 keep": (lambda s, df: simhash_dedup.keep_one_of_each(df), False),
    "10": (lambda s, df: with_neighbours(df), True),
    "12": (lambda s, df: mixing.plan(df), False),
    "12 mix": (lambda s, df: mixing.mix(df.where("doc_id is not null").dropDuplicates(["doc_id"])), False),
}


@pytest.fixture(scope="module")
def odd(spark):
    rows = documents(n=12)
    rows += [(7_000_001, None, None, None, None), (7_000_002, "no source", None, None, None), rows[0], rows[0]]
    df = frame(spark, rows)
    return df.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING)).repartition(3).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_nulls_and_repeats(spark, odd, name):
    run, keeps = OPERATORS[name]
    out = run(spark, odd)
    rows = out.collect()
    if not keeps:
        assert rows
        return
    assert len(rows) == odd.count()
    kept = [c for c in CLASHING if c in out.columns and c not in ("spans", "label")]
    assert len(kept) >= len(CLASHING) - 2
    for r in rows:
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in kept)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, name):
    assert OPERATORS[name][0](spark, odd.where("false")).count() == 0


#: Operators whose rows are compared by the id alone, and the columns that must not depend on what ids are made of.
BY_ID = {"2 find": ["item_id", "similarity"], "5": [], "8": ["ids"], "9": ["simhash"], "9 keep": ["text"], "10": ["text"], "12": [], "12 mix": ["text"]}


def by_texts(df):
    return df.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_id"), "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name", BY_ID)
def test_ids_that_are_texts(spark, odd, name):
    """The same rows as with numbers, or, where ids decide (the one that stays, the draws), rows of the same documents."""
    rows = OPERATORS[name][0](spark, by_texts(odd)).collect()
    if name in ("9 keep", "12 mix"):
        texts = {("doc " + str(r.doc_id) if r.doc_id is not None else None, r.text) for r in odd.select("doc_id", "text").collect()}
        assert rows and {(r.doc_id, r.text) for r in rows} <= texts
        return
    plain = OPERATORS[name][0](spark, odd).collect()
    shown = lambda r, i: (i, *(str(r[c]) for c in BY_ID[name]))
    want = Counter(shown(r, None if r.doc_id is None else f"doc {r.doc_id}") for r in plain)
    assert rows and Counter(shown(r, r.doc_id) for r in rows) == want


def test_leaks_in_odd_rows(spark, odd):
    """Exactly the documents that hold an item of bench: none but the one whose own text is an item, once for each id."""
    rows = OPERATORS["2 find"][0](spark, odd).collect()
    text = documents(n=12)[12][1]
    holders = {r.doc_id for r in odd.select("doc_id", "text").collect() if r.text == text}
    assert {r.doc_id for r in rows if r.item_id == 5 and r.similarity > 1 - 1e-9} == holders and len(holders) > 3
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows) and {r.item_id for r in rows} == {5}


def test_toxicity_of_odd_ids(spark, odd, tmp_path):
    """Null ids are held out; text ids get the scores of their texts."""
    labels_for(spark, documents()).write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None) and any(r.doc_id is None for r in rows)
    named = labels_for(spark, documents()).withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    scored = toxicity.fit(by_texts(odd), named).score(by_texts(odd)).collect()
    by_text = {}
    for r in scored:
        by_text.setdefault(r.text if "text" in r else r.doc_id, set()).add(r.score)
    assert len(scored) == odd.count() and all(len(s) == 1 for s in by_text.values())


def test_neighbours_of_text_ids(spark):
    ids = ["b", "a", "ab", "é", "z" * 20, "z" * 19, "", None]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string")
    got = {r.text: r.next_text for r in sketches.with_next(df, "doc_id", ["text"], rows_per_group=2).collect()}
    order = [f"text {i}" for i in sorted((i for i in ids if i is not None), key=lambda i: i.encode(), reverse=True)] + ["text None"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_text_ids_that_begin_alike_are_spread(spark):
    """Addresses of three hosts, of which one has most: groups of neighbours hold few each, and every row has the next one."""
    sizes = {"https://example.org/page/": 20_000, "https://example.com/": 500, "ftp://x/": 300}
    ids = [f"{host}{i}" for host, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string").repartition(4)
    code = {r[0]: r[1] for r in df.select("doc_id", sketches._place(df, "doc_id", ["text"])).collect()}
    order = sorted(ids, key=lambda i: i.encode())
    assert all(code[a] <= code[b] for a, b in zip(order, order[1:], strict=False)) and max(Counter(code.values()).values()) <= 50
    got = {r.doc_id: r.next_text for r in sketches.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {a: f"text {b}" for a, b in zip(order[::-1], [*order[-2::-1], order[-1]], strict=True)}


def test_stages(spark, odd, tmp_path):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels_for(spark, documents()).where("false").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.select("doc_id", "text", "lang", "source", "n_chars")):
            out = stage(spark, df, str(tmp_path))
            assert out.count() > 0 and (name == "byte_bpe" or out.columns == df.columns), name
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
    repeats_gone = corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path))
    assert repeats_gone.where("doc_id = 0").count() == 1
