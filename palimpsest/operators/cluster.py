"""Average-linkage clustering per segment, and its agreement with a given taxonomy.

The closest two clusters merge first; of equally close pairs the one with the least ids, where leaves are numbered in the order of their names and clusters in the order
of their creation. Small segments run one to a task. Larger ones go in rounds, in which all clusters that are each other's nearest merge at once: average linkage is reducible (a merged cluster is
never closer to a third than the closer of its parts was), so that those pairs merge in the one-by-one order too, only later or earlier. Of equally near neighbours the oldest counts, by the
one-by-one order, which ``_in_order`` works out from the merges so far.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.stats import adjusted_rand
from palimpsest.sources.raw import remove, scratch_dir

MERGES = "step int, left int, right int, height double, size int, items int"


def distances(pairs: DataFrame, items: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, items, pairs) per segment: its frequent items and the Jaccard distance of those pairs that were seen; all others are 1."""
    names = items.groupBy(segment).agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = pairs.groupBy(segment).agg(F.collect_list(F.struct("a", "b", (1 - F.col("jaccard")).alias("d"))).alias("pairs"))
    return names.join(near, segment, "left")


def _average_linkage(names: list[str], pairs) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size); the closest pair first, of equals the one with the least ids; new ids follow the leaves'."""
    n = len(names)
    at = {x: i for i, x in enumerate(names)}
    d = np.full((2 * n, 2 * n), np.inf)
    d[:n, :n] = 1.0
    for p in pairs if pairs is not None else []:
        if p["a"] in at and p["b"] in at:
            d[at[p["a"]], at[p["b"]]] = d[at[p["b"]], at[p["a"]]] = p["d"]
    d[np.tril_indices(2 * n)] = np.inf  # the upper half is enough: row is the lesser id
    size, out = [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), 2 * n)
        height, new = float(d[i, j]), n + step
        total = size[i] + size[j]
        get = lambda x: np.minimum(d[x, :new], d[:new, x])
        mean = (size[i] * get(i) + size[j] * get(j)) / total
        for x in (i, j):
            d[x, :], d[:, x] = np.inf, np.inf
        mean[[i, j]] = np.inf
        d[:new, new] = mean
        size.append(total)
        out.append((i, j, height, total))
    return out


def upgma_by_segment(table: DataFrame, segment: str = "segment", max_items: int = 2_000) -> DataFrame:
    """(segment, step, left, right, height, size, items): merges for every segment, one segment to a task; a segment with more than max_items fails. See ``upgma`` for those."""
    kind = dict(table.dtypes)[segment]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, names, pairs in zip(pdf[segment], pdf["items"], pdf["pairs"], strict=True):
            names = list(names)
            if len(names) > max_items:
                raise ValueError(f"segment {s!r} has {len(names)} items; the limit is {max_items}")
            rows += [(s, k, *merge, len(names)) for k, merge in enumerate(_average_linkage(names, pairs))]
        return pd.DataFrame(rows, columns=[segment, "step", "left", "right", "height", "size", "items"])

    return table.groupBy(segment).applyInPandas(run, f"{segment} {kind}, {MERGES}")


def _in_order(n: int, merges: list[tuple[int, int, int, float, int]]) -> list[tuple[int, int, int, float, int]]:
    """merges (node, one, other, height, size) in the one-by-one order, as (node, left, right, height, size) with ids: the leaves' are 0 to n - 1. A merge waits for its parts; of those that can be made the lowest is, of equals the one with the least ids."""
    ids, waiting, ready, out = {}, {}, [], []
    place = lambda x: x if x < n else ids.get(x)

    def offer(m):
        missing = next((x for x in m[1:3] if place(x) is None), None)
        if missing is None:
            left, right = sorted((place(m[1]), place(m[2])))
            heapq.heappush(ready, (m[3], left, right, m[0], m[4]))
        else:
            waiting.setdefault(missing, []).append(m)

    for m in merges:
        offer(m)
    while ready:
        height, left, right, node, size = heapq.heappop(ready)
        ids[node] = n + len(out)
        out.append((node, left, right, height, size))
        for m in waiting.pop(node, []):
            offer(m)
    return out


def _write(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """df as a table in the shared folder, whose path joins ``paths``."""
    spark = df.sparkSession
    paths.append(scratch_dir(spark, name))
    df.write.parquet(paths[-1])
    return spark.read.schema(df.schema).parquet(paths[-1])


def _ages(merges: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """(_s, node, age) of the clusters made so far: the ids that they would have if no others were made. A row per merge goes through here, no distance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        rows = _in_order(n, list(pdf[["node", "older", "younger", "height", "size"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"_s": pdf["_s"], "node": [r[0] for r in rows], "age": range(n, n + len(rows))})

    return merges.join(segments, "_s").groupBy("_s").applyInPandas(run, f"_s {kind}, node bigint, age bigint")


def _finish(merges: DataFrame, segments: DataFrame, kind: str) -> DataFrame:
    """All merges of each segment in order, with the last ones: what is left is 1 apart, so that the two oldest merge, again and again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        made = pdf[pdf["node"].notna()]
        rows = [r[1:] for r in _in_order(n, [(int(a), int(b), int(c), h, int(z)) for a, b, c, h, z in made[["node", "older", "younger", "height", "size"]].itertuples(index=False, name=None)])]
        rows = [(left, right, height, size) for height, left, right, size in ((r[2], r[0], r[1], r[3]) for r in rows)]
        used = {x for r in rows for x in r[:2]}
        sizes = [1] * n + [r[3] for r in rows]
        queue = deque(x for x in range(n + len(rows)) if x not in used)
        while len(queue) > 1:
            left, right = queue.popleft(), queue.popleft()
            sizes.append(sizes[left] + sizes[right])
            queue.append(n + len(rows))
            rows.append((left, right, 1.0, sizes[-1]))
        return pd.DataFrame([(pdf["_s"].iloc[0], k, *r, n) for k, r in enumerate(rows)], columns=["_s", "step", "left", "right", "height", "size", "items"])

    return segments.join(merges, "_s", "left").groupBy("_s").applyInPandas(run, f"_s {kind}, {MERGES}")


def upgma_in_rounds(pairs: DataFrame, items: DataFrame, segment: str = "segment") -> DataFrame:
    """The merges of ``upgma_by_segment`` from pairs(segment, a, b, jaccard) and items(segment, item), without a segment's distances ever being in one place.

    Only distances below 1 are rows; every other pair has exactly 1, and so has the mean of such. A round: the nearest neighbour of each cluster (an aggregate), the pairs that are
    each other's nearest (another), the order of what was made so far, and the distances to the new clusters (a third aggregate: of the up to four distances between the parts of two clusters, the older
    cluster's parts are averaged first, as one by one). Each round's tables are written to the shared folder, and those of the round before go. When no distance below 1 is left, clusters merge two by two in the order of their ids.
    The number of rounds is that of the longest chain of merges that need one another: about log n for groups, more for chains. Only a row per item and a row per merge of a segment meet in one task.
    """
    spark, kind = items.sparkSession, dict(items.dtypes)[segment]
    old: list[str] = []  # tables of the round before
    kept: list[str] = []  # tables that are needed to the end
    number = F.row_number().over(Window.partitionBy("_s").orderBy("item")) - 1
    leaves = _write(items.select(F.col(segment).alias("_s"), "item").distinct().withColumn("node", number.cast("bigint")), "leaves", kept)
    segments = _write(leaves.groupBy("_s").agg(F.count("*").alias("n")), "segments", kept)
    leaf = lambda name: leaves.select("_s", F.col("item").alias(name), F.col("node").alias(f"_{name}"))
    rows = pairs.select(F.col(segment).alias("_s"), "a", "b", (1 - F.col("jaccard")).alias("d")).where("d < 1").join(leaf("a"), ["_s", "a"]).join(leaf("b"), ["_s", "b"])
    rows = _write(rows.select("_s", F.col("_a").alias("a"), F.col("_b").alias("b"), "d"), "distances", old)
    clusters = leaves.select("_s", "node", F.col("node").alias("age"), F.lit(1).cast("bigint").alias("size"))
    made_schema = f"_s {kind}, node bigint, older bigint, younger bigint, n_older bigint, n_younger bigint, height double, size bigint"
    made_paths: list[str] = []
    merges = lambda: spark.read.schema(made_schema).parquet(*made_paths) if made_paths else spark.createDataFrame([], made_schema)
    while not rows.isEmpty():
        new: list[str] = []
        both = rows.select("_s", "a", "b", "d").union(rows.select("_s", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        aged = both.join(clusters.withColumnRenamed("node", "b"), ["_s", "b"])
        near = aged.groupBy("_s", "a").agg(F.min(F.struct("d", "age", "b", "size")).alias("m"))
        # A pair that is in there from both sides merges. Each row knows the age and the size of its neighbour.
        x, y = F.least("a", F.col("m.b")), F.greatest("a", F.col("m.b"))
        sides = near.select("_s", x.alias("x"), y.alias("y"), F.struct(F.col("m.age").alias("age"), F.col("m.b").alias("node"), F.col("m.size").alias("size")).alias("c"), F.col("m.d").alias("d"))
        mutual = sides.groupBy("_s", "x", "y").agg(F.count("*").alias("k"), F.min("c").alias("o"), F.max("c").alias("w"), F.min("d").alias("d")).where("k = 2")
        node = F.lit(len(made_paths) + 1).cast("bigint") * (1 << 32) + F.col("o.node") % (1 << 32)  # the round, and the older part's first leaf
        made = mutual.select("_s", node.alias("node"), F.col("o.node").alias("older"), F.col("w.node").alias("younger"), F.col("o.size").alias("n_older"), F.col("w.size").alias("n_younger"), F.col("d").alias("height"), (F.col("o.size") + F.col("w.size")).alias("size"))
        made = _write(made, "merges", made_paths)
        gone = made.select("_s", F.explode(F.array("older", "younger")).alias("node"))
        still = clusters.select("_s", "node", "size").join(gone, ["_s", "node"], "left_anti")
        ages = _ages(merges(), segments, kind)
        clusters = _write(still.union(made.select("_s", "node", "size")).join(ages, ["_s", "node"], "left").select("_s", "node", F.coalesce("age", "node").alias("age"), "size"), "clusters", new)
        # Where every cluster has gone: into a new one as its older (1) or younger (2) part, or nowhere (0).
        parts = made.select("_s", "node", "n_older", "n_younger", F.explode(F.array(F.struct(F.col("older").alias("from"), F.lit(1).alias("part")), F.struct(F.col("younger").alias("from"), F.lit(2).alias("part")))).alias("p"))
        went = parts.select("_s", "p.from", "node", "p.part", "n_older", "n_younger").union(still.select("_s", "node", "node", F.lit(0), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
        went = went.join(clusters.select("_s", "node", "age"), ["_s", "node"])
        to = lambda c: went.select("_s", F.col("from").alias(c), F.struct("age", "node", "part", "n_older", "n_younger").alias(f"to_{c}"))
        moved = rows.join(to("a"), ["_s", "a"]).join(to("b"), ["_s", "b"]).where("to_a.node <> to_b.node")
        ordered = moved.select("_s", "d", F.least("to_a", "to_b").alias("u"), F.greatest("to_a", "to_b").alias("v"))  # u is the older
        whole = lambda c: F.struct(*(F.col(f"{c}.{k}").alias(k) for k in ("age", "node", "n_older", "n_younger"))).alias(c)
        cell = lambda i, j: F.max(F.when(((F.col("u.part") == 2) == (i == 2)) & ((F.col("v.part") == 2) == (j == 2)), F.col("d"))).alias(f"d{i}{j}")
        cells = ordered.groupBy("_s", whole("u"), whole("v")).agg(*(cell(i, j) for i in (1, 2) for j in (1, 2)))
        mean = lambda c, one, two: F.when(F.col(f"{c}.n_older").isNull(), one).otherwise((one * F.col(f"{c}.n_older") + two * F.col(f"{c}.n_younger")) / (F.col(f"{c}.n_older") + F.col(f"{c}.n_younger")))
        seen = lambda i, j: F.coalesce(F.col(f"d{i}{j}"), F.lit(1.0))
        d = mean("v", mean("u", seen(1, 1), seen(2, 1)), mean("u", seen(1, 2), seen(2, 2)))
        rows = _write(cells.select("_s", F.col("u.node").alias("a"), F.col("v.node").alias("b"), d.alias("d")).where("d < 1"), "distances", new)
        for path in old:
            remove(spark, path)
        old = new
    done = _write(_finish(merges(), segments, kind), "linkage", [])
    for path in (*old, *kept, *made_paths):
        remove(spark, path)
    return done.withColumnRenamed("_s", segment)


def upgma(pairs: DataFrame, items: DataFrame, segment: str = "segment", in_one_task: int = 2_000) -> DataFrame:
    """Merges of every segment, whatever its size: those with up to ``in_one_task`` items side by side, a task each, larger ones in rounds. Either way gives the same merges."""
    sizes = items.groupBy(segment).agg(F.countDistinct("item").alias("_n"))
    large = sizes.where(F.col("_n") > in_one_task).select(segment)
    if large.isEmpty():
        return upgma_by_segment(distances(pairs, items, segment), segment, in_one_task)
    rest = lambda df: df.join(large, segment, "left_anti")
    of = lambda df: df.join(large, segment, "left_semi")
    small = upgma_by_segment(distances(rest(pairs), rest(items), segment), segment, in_one_task)
    return small.unionByName(upgma_in_rounds(of(pairs), of(items), segment))


def cuts(merges: DataFrame, names: DataFrame, segment: str = "segment", most: int = 20) -> DataFrame:
    """(segment, k, item, label) for every k from 2 to ``most``: the label is the highest cluster that exists before n - k merges.

    names: segment, items (sorted). Of a segment's n - 1 merges the last ``most`` - 1 make the difference between the cuts. Below them, each node's highest ancestor is found by pointer jumping: in every
    round a node's pointer becomes its pointer's pointer, so that the number of rounds is the logarithm of the tree's height. Above, at most ``most`` - 1 merges a segment are walked.
    """
    merges = _write(merges.select(segment, "step", "left", "right", "items"), "merges", [])
    top = F.greatest(F.lit(2), F.least(F.lit(most), F.col("items")))  # cuts go up to so many groups
    low = merges.where(F.col("step") < F.col("items") - top).select(segment, F.explode(F.array("left", "right")).alias("node"), (F.col("items") + F.col("step")).alias("up"))
    pointers = low
    while True:
        here: list[str] = []
        jumped = pointers.join(pointers.select(segment, F.col("node").alias("up"), F.col("up").alias("_up")), [segment, "up"], "left")
        pointers = _write(jumped.select(segment, "node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("_moved")), "pointers", here)
        moved = not pointers.where("_moved").isEmpty()
        pointers = pointers.drop("_moved")
        if not moved:
            break
    sizes = merges.groupBy(segment).agg(F.max("items").alias("n"))
    high = merges.where(F.col("step") >= F.col("items") - top).select(segment, F.explode(F.array("left", "right")).alias("node"), F.struct((F.col("items") + F.col("step")).alias("node"), "step").alias("up"))
    tops = high.groupBy(segment).agg(F.map_from_entries(F.collect_list(F.struct("node", "up"))).alias("ups"))  # at most twice ``most`` entries
    leaves = names.select(segment, F.posexplode("items").alias("leaf", "item")).join(sizes, segment).join(tops, segment, "left")
    rooted = leaves.join(pointers.select(segment, F.col("node").alias("leaf"), "up"), [segment, "leaf"], "left").withColumn("root", F.coalesce("up", "leaf"))
    each = rooted.where("n >= 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(most), F.col("n"))))))
    above = lambda x: F.element_at("ups", x)
    climb = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col("root"), lambda x, _: F.when(above(x)["step"] < F.col("n") - F.col("k"), above(x)["node"]).otherwise(x))
    return each.select(segment, "k", "item", climb.alias("label"))


def agreement_curve(labels: DataFrame, taxonomy: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, k, ari) with the group of each item (none counts as a group)."""
    both = labels.join(taxonomy.select("item", F.coalesce(F.col("group").cast("string"), F.lit("")).alias("group")), "item", "left").na.fill("", ["group"])
    return adjusted_rand(both, "label", "group", [segment, "k"])


def elbow(merges: DataFrame, segment: str = "segment", most: int = 20) -> DataFrame:
    """(segment, k): before the highest jump of the merge heights, for 2 <= k <= max(2, min(most, n // 2)); ties give the larger k; 2 if there is none."""
    w = Window.partitionBy(segment).orderBy("step")
    jumps = merges.withColumn("jump", F.lead("height").over(w) - F.col("height")).withColumn("k", F.col("items") - F.col("step") - 1)
    top = F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("items") / 2)))
    fits = F.col("jump").isNotNull() & (F.col("k") >= 2) & (F.col("k") <= top)
    return jumps.groupBy(segment).agg(F.coalesce(F.max_by(F.when(fits, F.col("k")), F.when(fits, F.struct("jump", "k"))), F.lit(2)).alias("k"))


def best_agreement(curve: DataFrame, segment: str = "segment", enough: float = 0.2) -> DataFrame:
    """The k with the highest ari (undefined ones last), and whether it reaches ``enough``."""
    best = F.max_by(F.struct("k", "ari"), F.struct(F.nanvl(F.col("ari"), F.lit(-2.0)), -F.col("k")))
    return curve.groupBy(segment).agg(best.alias("b")).select(segment, "b.k", "b.ari", (F.nanvl("b.ari", F.lit(-2.0)) >= enough).alias("agrees"))
