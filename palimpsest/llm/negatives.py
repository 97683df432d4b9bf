"""Hard-negative mining: for each anchor its most similar rows of the same label, and for each of those the most similar rows of other labels in a window below it.

Exact top-k search by anchor-clustered shared lists (the method of MAXIMUS). Anchors are clustered by direction. A cluster with centre c, whose
members are within the angle b of c, has one list of the candidates, sorted by the bound |x| cos(max(0, angle(x, c) - b)): no member's inner product
with x can be more than that times the member's norm (the angle between member and x is at least angle(x, c) - b). Every member walks that list from the top and leaves it
for certain once the bound, times its norm, is under what it still needs: its k-th best score so far or the window's lower end.

As Spark work: the anchors are the stated query set. They go in waves of bounded size, each a broadcast of at most ``wave`` vectors, against all rows, whose
lists are sorted a batch at a time inside the tasks. A task keeps the best k of each walker over all its batches and emits those. What a wave's walkers need is learned in rounds over
growing shares of the rows (``first`` rows, then ``growth`` times as many, by a hash of the id), so that later and larger rounds emit only what beats the k-th best
of the smaller ones. Every row is met by every anchor's list exactly once; neither waves nor rounds drop a row. Scores are integers below 2^53, so products in floating
point are exact in any order.

Rows with a null key, a null label, or a null, empty or incomplete vector take no part, nor do vectors of another length than that of the least key. Rows with the anchor's own key are never its partners; an anchor
that is repeated counts once, as its least (label, vector), and other repeated rows are rows of their own. Empty tables give no rows. Components whose products aren't exact raise ValueError.
The tables of partial lists that a result reads stay in the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, stored
from palimpsest.llm.vectors import as_integers, dimension, is_complete

#: Walkers that share one multiplication, and the longest stretch of a list in one.
_WALKERS, _STRETCH = 1024, 1024
#: Added to a bound's cosine: far above what rounding takes off an angle.
_SLACK = 1e-6
_BUCKETS = 1 << 20


@dataclass
class Wave:
    """A bounded set of anchors, by cluster."""

    ids: np.ndarray
    labels: pa.Array  # the distinct ones
    label: np.ndarray  # places in labels
    vectors: np.ndarray
    cluster: np.ndarray
    centers: np.ndarray
    spread: np.ndarray  # the largest angle between a cluster's members and its centre


@dataclass
class Walkers:
    """What is looked for: the best k scores from low to high among rows with (or without) an anchor's label. need: no less than this is of use."""

    anchor: np.ndarray  # places in the wave
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    same: bool
    k: int


def best_of(walker: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each walker's first k: higher scores first, ties by lower id."""
    order = np.lexsort((ids, -score, walker))
    w = walker[order]
    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
    return order[rank < k]


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; zero stays zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def cluster_centers(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a bounded sample. Only the lists' order depends on it, no result."""
    unit = directions(sample)
    centers = unit[:: max(1, len(unit) // clusters)][:clusters].copy()
    for _ in range(rounds):
        at = (unit @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, at, unit)
        filled = np.linalg.norm(total, axis=1) > 0
        centers[filled] = directions(total[filled])
    return centers


def walk(wave: Wave, walkers: Walkers, ids: np.ndarray, label: np.ndarray, x: np.ndarray, kept: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """kept (walker, id, score) with the rows of a batch: every walker goes down its cluster's list as far as it must. Raises walkers.need."""
    norm = np.linalg.norm(x, axis=1)
    angle = np.arccos(np.clip(directions(x) @ wave.centers.T, -1, 1))
    own_norm, own_cluster = np.linalg.norm(wave.vectors, axis=1), wave.cluster[walkers.anchor]
    for c in np.unique(own_cluster):
        bound = norm * (np.cos(np.maximum(0, angle[:, c] - wave.spread[c])) + _SLACK)
        order = np.argsort(-bound, kind="stable")
        cluster = np.flatnonzero(own_cluster == c)
        for first in range(0, len(cluster), _WALKERS):
            group, start, stretch = cluster[first : first + _WALKERS], 0, 64
            while start < len(order):
                anchor = walkers.anchor[group]
                group = group[bound[order[start]] * own_norm[anchor] >= walkers.need[group]]  # the others are certainly done
                if not len(group):
                    break
                anchor, part = walkers.anchor[group], order[start : start + stretch]
                once, back = np.unique(anchor, return_inverse=True)
                score = (wave.vectors[once] @ x[part].T)[back]
                fits = (score >= walkers.need[group, None]) & (score <= walkers.high[group, None])
                fits &= ((label[part] == wave.label[anchor, None]) == walkers.same) & (ids[part] != wave.ids[anchor, None])
                row, column = np.nonzero(fits)
                if len(row):
                    every = tuple(np.concatenate(both) for both in zip(kept, (group[row], ids[part[column]], score[row, column].astype(np.int64)), strict=True))
                    first_k = best_of(*every, walkers.k)
                    kept = tuple(a[first_k] for a in every)
                    w, last = np.unique(kept[0], return_counts=True)
                    full = w[last == walkers.k]
                    worst = kept[2][np.cumsum(last) - 1]  # the order is by walker, then falling scores
                    walkers.need[full] = np.maximum(walkers.need[full], worst[last == walkers.k])
                start, stretch = start + len(part), min(2 * stretch, _STRETCH)
    return kept


def _search(rows: DataFrame, wave: Wave, walkers: Walkers, d: int, scale: int, shares: list[tuple[int, int]], name: str) -> list[str]:
    """Paths of tables (walker, id, score) that together hold the first k of every walker: one table for each round."""
    spark = rows.sparkSession
    limit, paths = math.isqrt((1 << 53) // d), []
    for k, (low, high) in enumerate(shares):
        sent = spark.sparkContext.broadcast((wave, walkers))

        def lists(batches, sent=sent):
            wave, walkers = sent.value
            walkers = Walkers(walkers.anchor, walkers.low, walkers.high, walkers.need.copy(), walkers.same, walkers.k)
            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for batch in batches:
                if batch.num_rows:
                    label = pc.fill_null(pc.index_in(batch.column(1), value_set=wave.labels), -1).to_numpy(zero_copy_only=False)
                    x = as_integers(batch.column(2), d, scale, limit).astype(np.float64)
                    kept = walk(wave, walkers, batch.column(0).to_numpy(zero_copy_only=False), label, x, kept)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in kept], names=["walker", "id", "score"])

        part = rows if (low, high) == (0, _BUCKETS) else rows.where(F.pmod(F.xxhash64("_id"), F.lit(_BUCKETS)).between(low, high - 1))
        paths.append(stored(part.select("_id", "_label", "_v").mapInArrow(lists, "walker bigint, id bigint, score bigint"), name))
        if k + 1 < len(shares):
            found = _first(spark.read.parquet(*paths), ["walker"], walkers.k).where(F.col("rank") == walkers.k).select("walker", "score").toArrow()  # a row per walker at most
            at = found["walker"].to_numpy()
            walkers.need[at] = np.maximum(walkers.need[at], found["score"].to_numpy())
        sent.unpersist()
    return paths


def _first(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    clusters: int = 16,
    wave: int = 8192,
    sample: int = 4096,
    first: int = 65_536,
    growth: int = 32,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, each of its ``positives`` best rows of its label, and for
    those the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Keys are integers.

    ``clusters`` centres come from a sample of at most ``sample`` anchors for every wave's worth of them; ``wave``, ``first`` and ``growth`` as in the module's head.
    """
    spark = df.sparkSession
    kept = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & is_complete(F.col(vector)))
    d = dimension(kept, key, vector)
    rows = kept.where(F.size(vector) == d).select(F.col(key).cast("bigint").alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v"), is_anchor.alias("_anchor"))
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not d:
        return spark.createDataFrame([], shape)
    anchors = rows.where("_anchor").groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("a")).select("_id", "a.*")
    few = anchors.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").toArrow()["_v"].combine_chunks()
    if not len(few):
        return spark.createDataFrame([], shape)
    limit = math.isqrt((1 << 53) // d)
    centers = cluster_centers(as_integers(few, d, scale, limit).astype(np.float64), clusters)

    def nearest_center(batches):
        for batch in batches:
            unit = directions(as_integers(batch.column(2), d, scale, limit).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((unit @ centers.T).argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "_cluster"])

    kind = dict(rows.dtypes)["_label"]
    own_table = stored(anchors.mapInArrow(nearest_center, f"_id bigint, _label {kind}, _v array<double>, _cluster int"), "anchors")
    placed = spark.read.parquet(own_table)
    sizes = {r["_cluster"]: r["count"] for r in placed.groupBy("_cluster").count().collect()}  # a row per centre
    # A cluster larger than a wave is cut by a hash of the id; the pieces are packed into waves in the clusters' order.
    pieces = F.coalesce(F.element_at(F.create_map(*(F.lit(int(x)) for c, n in sizes.items() for x in (c, math.ceil(n / wave)))), F.col("_cluster")), F.lit(1))
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64("_id", F.lit(1)), pieces).cast("int"))
    waves, room = [], 0
    for r in placed.groupBy("_cluster", "_piece").count().orderBy("_cluster", "_piece").collect():  # rows: centres + anchors / wave
        if not waves or room + r["count"] > wave:
            waves.append([])
            room = 0
        waves[-1].append((r["_cluster"], r["_piece"]))
        room += r["count"]
    total, share, shares = rows.count(), 0, []
    reach = first
    while share < _BUCKETS:
        upto = _BUCKETS if reach >= total else max(share + 1, reach * _BUCKETS // total)
        shares.append((share, upto))
        share, reach = upto, reach * growth

    out: list[str] = []
    for own in waves:
        inside = F.struct("_cluster", "_piece").isin(*(F.struct(F.lit(c), F.lit(p)) for c, p in own))
        table = placed.where(inside).orderBy("_cluster", "_id").toArrow()  # at most a wave
        vectors = as_integers(table["_v"].combine_chunks(), d, scale, limit).astype(np.float64)
        labels, cluster = table["_label"].combine_chunks(), table["_cluster"].to_numpy()
        distinct = pc.unique(labels)
        to_center = np.arccos(np.clip((directions(vectors) * centers[cluster]).sum(axis=1), -1, 1))
        spread = np.zeros(len(centers))
        np.maximum.at(spread, cluster, to_center)
        this = Wave(table["_id"].to_numpy(), distinct, pc.index_in(labels, value_set=distinct).to_numpy(zero_copy_only=False), vectors, cluster, centers, spread)
        m = len(this.ids)
        nothing = np.full(m, -np.inf)
        near = _search(rows, this, Walkers(np.arange(m), nothing, -nothing, nothing.copy(), True, positives), d, scale, shares, "positives")
        pairs = _first(spark.read.parquet(*near), ["walker"], positives).select("walker", "id", "score").distinct().orderBy("walker", F.desc("score"), "id").toArrow()  # at most wave * positives
        discard(spark, near)
        anchor, positive, score = (pairs[c].to_numpy() for c in ("walker", "id", "score"))
        bottom, top = -((-low * score) // 100), (high * score) // 100
        some = bottom <= top
        if not some.any():
            continue
        anchor, positive, score, bottom, top = (a[some] for a in (anchor, positive, score, bottom, top))
        far = _search(rows, this, Walkers(anchor, bottom.astype(float), top.astype(float), bottom.astype(float), False, negatives), d, scale, shares, "negatives")
        names = spark.createDataFrame(pa.table({"walker": np.arange(len(anchor)), "anchor_id": this.ids[anchor], "positive_id": positive, "positive_score": score}))
        out.append(stored(_first(spark.read.parquet(*far), ["walker"], negatives).join(F.broadcast(names), "walker").drop("walker"), "mined"))
        discard(spark, far)
    discard(spark, [own_table])
    if not out:
        return spark.createDataFrame([], shape)
    return spark.read.parquet(*out).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every anchor in the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM r
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, any_value(a.label = b.label) AS same, sum(a.x * b.x)::BIGINT AS score
  FROM cells a JOIN cells b ON a.i = b.i AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10
"""
