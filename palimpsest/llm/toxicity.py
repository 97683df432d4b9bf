"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: the labelled documents' words and word beginnings (3 to 7 letters) whose odds
of standing in a toxic document are clearly raised, with the lower bound of the log odds ratio as
weight. Features are lexicon densities, the nearness of lexicon words to words of the second person, shares of capitals and
punctuation, and rates of obfuscation (digits or signs inside words, stretched letters; such words are
also looked up as they read without it). Training documents get the features from a lexicon that their own fold
took no part in. Trees are grown on three folds, the isotonic step on the fourth.

Labelled rows beyond ``max_labelled`` are thinned by a hash of the id: the lexicon and the trees are fitted on a
bounded sample, whatever the input's size, and that bound is all that is collected or broadcast. Every text is scored whole.
Null and empty texts have zero features; rows without a label or an id train nothing, so that rows without an id count as held out. Where the labels, or the labelled documents, hold fewer than
ten rows of a class, every score is the share of label 1. Columns of the input that are named like a new one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import free_name, materialize

MAX_LABELLED = 12_000
MAX_LEXICON = 6_000
FOLDS = 4
FEATURES = (
    "words", "lexicon_hits", "lexicon_weight", "lexicon_best", "lexicon_distinct", "lexicon_strong", "begin_hits", "begin_weight", "begin_best", "near_you", "you",
    "capitals", "all_caps", "exclaims", "questions", "punctuation", "digits", "inner_signs", "stretched", "veiled_hits",
)
#: Words of the second person in the corpus's languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_SIGNS = re.compile(r"[^\w\s'’.-]|\d")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_SPLIT = re.compile(r"[\W_]+")


def plain_word(raw: str) -> tuple[str, bool, bool]:
    """A word as it reads without obfuscation; whether signs or digits stood in it; whether letters were stretched."""
    low = raw.lower()
    signs = _SIGNS.search(low) is not None and any(c.isalpha() for c in low)
    stretched = _STRETCHED.search(low) is not None
    if signs:
        low = low.translate(_LEET)
    if stretched:
        low = _STRETCHED.sub(r"\1", low)
    return _SPLIT.sub("", low), signs, stretched


def _units(word: str) -> list[str]:
    """The word itself (=word) and its beginnings (word-)."""
    return ["=" + word, *(word[:k] + "-" for k in range(3, min(7, len(word)) + 1))]


class Lexicon:
    """Weights of words and beginnings; remembers, up to a bound, what a written word adds."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.seen = weights, {}

    def look_up(self, raw: str) -> tuple[float, float, bool, bool, bool, str]:
        found = self.seen.get(raw)
        if found is None:
            word, signs, stretched = plain_word(raw)
            get = self.weights.get
            whole = get("=" + word, 0.0)
            begin = max((get(u, 0.0) for u in _units(word)[1:]), default=0.0)
            if len(self.seen) >= 400_000:
                self.seen.clear()
            found = self.seen[raw] = (whole, begin, signs, stretched, word in SECOND_PERSON, word)
        return found

    def features(self, text: str) -> list[float]:
        raws = _WORD.findall(text)
        n, chars = max(1, len(raws)), max(1, len(text))
        hits = strong = begins = near = you = veiled = 0
        weight = best = begin_weight = begin_best = 0.0
        signs = stretched = 0
        distinct: set[str] = set()
        last_you, last_hit, look = -99, -99, self.seen.get
        for i, raw in enumerate(raws):
            whole, begin, s, r, second, word = look(raw) or self.look_up(raw)
            signs += s
            stretched += r
            if second:
                you += 1
                last_you = i
                near += i - last_hit <= 5
            if whole > 0.0:
                hits += 1
                weight += whole
                best = max(best, whole)
                strong += whole > 2.0
                distinct.add(word)
                last_hit = i
                near += i - last_you <= 5
                veiled += s or r
            if begin > 0.0:
                begins += 1
                begin_weight += begin
                begin_best = max(begin_best, begin)
        caps = sum(map(str.isupper, text))
        shouts = sum(1 for w in raws if len(w) > 2 and w.isupper())
        exclaims, questions = text.count("!"), text.count("?")
        signs_all = len(text) - sum(map(str.isalnum, text)) - sum(map(str.isspace, text))
        digits = sum(map(str.isdigit, text))
        return [
            float(np.log1p(len(raws))), hits / n, weight / n, best, float(len(distinct)), float(strong), begins / n, begin_weight / n, begin_best, near / n, you / n,
            caps / chars, shouts / n, exclaims / n, questions / n, signs_all / chars, digits / chars, signs / n, stretched / n, veiled / n,
        ]


def _bound(t: int, z: int, toxic: int, clean: int) -> float:
    """Lower end (1.64 standard errors) of the log odds ratio of a unit in t of the toxic and z of the clean documents."""
    odds = np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((z + 0.5) / (clean - z + 0.5))
    return float(odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (z + 0.5)))


def learn_lexicons(labelled: DataFrame, text_col: str, fold_col: str, label_col: str) -> tuple[dict[str, float], list[dict[str, float]]]:
    """From all folds, and from all but each. What reaches the driver is bounded by the labelled sample, units in fewer than three toxic documents stay out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[Counter] = [Counter() for _ in range(FOLDS)]
        clean: list[Counter] = [Counter() for _ in range(FOLDS)]
        for batch in batches:
            for text, fold, label in zip(batch.column(text_col).to_pylist(), batch.column(fold_col).to_pylist(), batch.column(label_col).to_pylist(), strict=True):
                units = {u for raw in set(_WORD.findall(text or "")) for u in _units(plain_word(raw)[0])}
                (toxic if label else clean)[fold].update(units)
        for fold in range(FOLDS):
            units = list(toxic[fold].keys() | clean[fold].keys())
            for i in range(0, len(units), 50_000):
                part = units[i : i + 50_000]
                columns = [pa.array(part), pa.array([fold] * len(part), pa.int32()), pa.array([toxic[fold][u] for u in part], pa.int64()), pa.array([clean[fold][u] for u in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "fold", "t", "z"])

    counts = labelled.select(text_col, fold_col, label_col).mapInArrow(count, "unit string, fold int, t long, z long")
    by_fold = counts.groupBy("unit").agg(
        *(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "tz" for f in range(FOLDS)), F.sum("t").alias("t"), F.sum("z").alias("z")
    )
    sizes = {(r[0], r[1]): r[2] for r in labelled.groupBy(fold_col, label_col).count().collect()}
    toxic = [sizes.get((f, 1), 0) for f in range(FOLDS)]
    clean = [sizes.get((f, 0), 0) for f in range(FOLDS)]
    ratio = sum(clean) / max(1, sum(toxic))
    rows = by_fold.where((F.col("t") >= 3) & (F.col("t") * ratio > 2 * F.col("z"))).orderBy(F.desc(F.col("t") / (F.col("z") + 1)), "unit").limit(10 * MAX_LEXICON).collect()

    def lexicon(left_out: int | None) -> dict[str, float]:
        use = [f for f in range(FOLDS) if f != left_out]
        nt, nz, out = sum(toxic[f] for f in use), sum(clean[f] for f in use), {}
        for r in rows:
            t, z = sum(r[f"t{f}"] for f in use), sum(r[f"z{f}"] for f in use)
            if t >= 3 and (w := _bound(t, z, nt, nz)) > 0.7:
                out[r["unit"]] = w
        return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_LEXICON])

    return lexicon(None), [lexicon(f) for f in range(FOLDS)]


def with_features(df: DataFrame, text_col: str, lexicons: list[dict[str, float]], fold_col: str | None = None) -> DataFrame:
    """df's other columns and the array ``features``; with a fold column, each row by the lexicon of its fold."""
    sent = df.sparkSession.sparkContext.broadcast(lexicons)
    rest = [c for c in df.columns if c not in (text_col, "features")]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Lexicon(x) for x in sent.value]
        for batch in batches:
            folds = batch.column(fold_col).to_pylist() if fold_col else [0] * batch.num_rows
            rows = [known[f].features(t.as_py() or "") for f, t in zip(folds, batch.column(text_col), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(rows, pa.list_(pa.float64()))], names=[*rest, "features"])

    return df.select(*rest, text_col).mapInArrow(run, schema)


def _vectors(df: DataFrame) -> DataFrame:
    df = df.select("*", *(F.get("features", i).alias(f"_f{i}") for i in range(len(FEATURES)))).drop("features")
    out = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(FEATURES))], outputCol="_features").transform(df)
    return out.drop(*(f"_f{i}" for i in range(len(FEATURES))))


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds the column of that name, between 0 and 1."""

    def __init__(self, lexicon, trees, isotonic, share):
        self.lexicon, self.trees, self.isotonic, self.share = lexicon, trees, isotonic, share

    def score(self, df: DataFrame, text_col: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in (df.columns if keep is None else keep) if c != out]
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias(out))
        # The other columns travel as one struct, so that their names can't clash with those used here.
        packed = df.select((F.struct(*keep) if keep else F.lit(0)).alias("_kept"), F.col(text_col).alias("_whole"))
        scored = self._raw(_vectors(with_features(packed, "_whole", [self.lexicon])))
        return scored.select(*(F.col("_kept")[c].alias(c) for c in keep), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias(out))

    def _raw(self, df: DataFrame) -> DataFrame:
        out = self.trees.transform(df).withColumn("_margin", vector_to_array("probability")[1])
        return self.isotonic.transform(out) if self.isotonic else out.withColumn("_score", F.col("_margin"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from labelled rows whose crc32 of the id (as text) leaves a remainder by 5."""
    spark, crc = docs.sparkSession, F.crc32(F.col(id_col).cast("string"))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc % 5 != 0)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    sizes = {r[0]: r[1] for r in usable.groupBy("_label").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 10:
        return ToxicityModel({}, None, None, share)
    dice = F.pmod(F.xxhash64(F.lit("thin"), F.col(id_col)), F.lit(1_000_000))
    chosen = usable.where(dice < int(1_000_000 * min(1.0, max_labelled / total))).withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col).select("_text", "_fold", F.col("_label").cast("int").alias("_label"))
    rows = materialize(rows, "labelled")
    there = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if min(there.get(0, 0), there.get(1, 0)) < 10 or not rows.where("_fold > 0").limit(1).count():
        return ToxicityModel({}, None, None, share)
    lexicon, without = learn_lexicons(rows, "_text", "_fold", "_label")
    ready = materialize(with_features(rows.repartition(16), "_text", without, "_fold"), "features")
    ready = _vectors(ready).withColumn("label", F.col("_label").cast("double"))
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5)
    grow, calibrate = ready.where(F.col("_fold") > 0), ready.where(F.col("_fold") == 0)
    model = ToxicityModel(lexicon, gbt.fit(grow), None, share)
    if calibrate.where("label = 1").limit(10).count() == 10 and calibrate.where("label = 0").limit(10).count() == 10:
        model.isotonic = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(model._raw(calibrate).select("_margin", "label"))
    return model


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with a score below the threshold."""
    name = free_name(docs, "_toxicity")
    return fit(docs, labels).score(docs, out=name).where(F.col(name) < threshold).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = fit(docs.select("doc_id", "text"), labels).score(docs.select("doc_id", "text"), keep=["doc_id"])
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
