"""Toxicity by held-out accuracy, and the pipeline stage by stage."""

import math
import zlib

import pytest

import corpus_pipeline
from palimpsest.llm import toxicity
from tests.llm.fixtures import frame

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_held_out(spark, tables):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.op3_toxicity(spark, DATA).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.85


def test_without_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.fit(docs, none).score(docs).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}


def test_plain_words():
    assert toxicity.plain_word("1d1ot")[:2] == ("idiot", True) and toxicity.plain_word("looooser") == ("loser", False, True) and toxicity.plain_word("2024")[1] is False


def test_features_against_plain_code(spark):
    """Each feature of a few texts, counted word by word and letter by letter."""
    weights = {"=idiot": 3.0, "=fool": 1.5, "idi-": 1.0, "foo-": 0.9}
    texts = ["You are an idiot, you FOOL!!", "A fool? No: 1d1ots and fooool. YOUR 2024 plan", "Quiet prose without any such word.", "", None, "idiot " * 3 + "x " * 9 + "you"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: dict(zip(toxicity.FEATURES, r.features, strict=True)) for r in toxicity.with_features(df, "text", [weights]).collect()}
    for n, text in enumerate(texts):
        text = text or ""
        raws = [w.strip(",.!?:") for w in text.split()]
        read = [w.lower().replace("1", "i") if w[0].isalpha() or w == "1d1ots" else w for w in raws]
        read = ["fol" if w == "fooool" else w for w in read]
        count, chars = max(1, len(raws)), max(1, len(text))
        whole = [weights.get("=" + w, 0.0) for w in read]
        begin = [max((weights.get(w[:k] + "-", 0.0) for k in range(3, 8) if len(w) >= k), default=0.0) for w in read]
        at, you = [i for i, w in enumerate(whole) if w], [i for i, w in enumerate(read) if w in toxicity.SECOND_PERSON]
        near = sum(any(0 <= i - j <= 5 for j in you) for i in at) + sum(any(0 <= i - j <= 5 for j in at) for i in you)
        want = {
            "words": math.log1p(len(raws)), "lexicon_hits": len(at) / count, "lexicon_weight": sum(whole) / count, "lexicon_best": max(whole, default=0.0), "lexicon_distinct": len({read[i] for i in at}),
            "lexicon_strong": sum(w > 2 for w in whole), "begin_hits": sum(w > 0 for w in begin) / count, "begin_weight": sum(begin) / count, "begin_best": max(begin, default=0.0),
            "near_you": near / count, "you": len(you) / count, "capitals": sum(c.isupper() for c in text) / chars, "all_caps": sum(len(w) > 2 and w.isupper() for w in raws) / count,
            "exclaims": text.count("!") / count, "questions": text.count("?") / count, "punctuation": sum(not c.isalnum() and not c.isspace() for c in text) / chars,
            "digits": sum(c.isdigit() for c in text) / chars, "inner_signs": sum(w == "1d1ots" for w in raws) / count, "stretched": sum(w == "fooool" for w in raws) / count,
            "veiled_hits": 0.0,
        }
        assert got[n] == pytest.approx(want), text
    [veiled] = toxicity.with_features(spark.createDataFrame([("1d1ot! idi0t",)], "text string"), "text", [weights]).collect()
    assert dict(zip(toxicity.FEATURES, veiled.features, strict=True))["veiled_hits"] == 1.0


def test_pipeline(spark, tables):
    docs, _ = tables
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept.count(), stage(spark, kept, DATA).cache()
        assert kept.count() <= before and kept.count() > 0.7 * before, name
        if name != "byte_bpe":
            assert kept.columns == columns
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in kept.collect())
