"""What is requested together: item sets, pairs, networks, association measures.

Pairs come from the sorted array inside each row (no self-join, no shuffle before the count). A set with
more than ``upper`` items is a template and should be filtered before, since its pairs grow with the square; one that isn't is cut into blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.stats import benjamini_hochberg, fisher_right, jaccard, lift
from palimpsest.functions.text import level_list, level_shares
from palimpsest.sources.raw import numbered, running, staged

TASK_ROWS, TASK_PAIRS, KNOWN_BYTES = 1_000_000, 100_000_000, 64 << 20  # rows (item, chunk) and pairs of one task; items that every task may know


def baskets(rows: DataFrame, key: str, item: str, carried: list[str] | None = None) -> DataFrame:
    """(key, items): sorted distinct items; ``carried`` columns are constant per key."""
    carried = carried or []
    return rows.where(F.col(item).isNotNull()).groupBy(key, *carried).agg(F.array_sort(F.collect_set(item)).alias("items"))


def pairs_in(items: Column) -> Column:
    """array<struct(a, b)> of all unordered pairs of a sorted array."""
    rest = lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(items, lambda x, i: rest(x, i)))


def template_dedup(sets: DataFrame, owner: str) -> DataFrame:
    """One row per (owner, item set) with at least two items; a missing owner is one owner."""
    return sets.where(F.size("items") > 1).withColumn(owner, F.coalesce(F.col(owner).cast("string"), F.lit("s/e"))).select(owner, "items").distinct()


def owned_sets(sets: DataFrame, owner: str) -> DataFrame:
    """(owner, items, n): each owner's item sets of any size, and how many entities have them; a missing owner is one owner."""
    return sets.groupBy(F.coalesce(F.col(owner).cast("string"), F.lit("s/e")).alias(owner), "items").agg(F.count("*").alias("n"))


def funnel(sets: DataFrame, owner: str, small: int = 30, warn: int = 40) -> DataFrame:
    """Sets with items, with one, with several, after removing templates, the share lost and small-base warnings."""
    return funnel_of(owned_sets(sets, owner), small, warn)


def funnel_of(owned: DataFrame, small: int = 30, warn: int = 40) -> DataFrame:
    """The funnel of sets that are counted by owner already (``owned_sets``)."""
    size, among = F.size("items"), lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0).cast("bigint"))
    out = owned.agg(among(F.lit(True)).alias("with_items"), among(size == 1).alias("single"), among(size > 1).alias("multi"), F.count_if(size > 1).alias("dedup"))
    lost = F.try_divide(F.col("multi") - F.col("dedup"), F.col("multi"))
    return out.select("*", lost.alias("lost"), (F.col("dedup") < small).alias("very_small"), (F.col("dedup") < warn).alias("small"))


def degrees(sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sets.select(*(by or []), F.explode("items").alias("item")).groupBy(*(by or []), "item").agg(F.count("*").alias("degree"))


def block_pairs(sets: DataFrame, by: list[str], block: int) -> DataFrame:
    """(by, p: struct(a, b)) of all pairs of sets of any size: a set is cut into blocks of items, and pairs are made block by block.

    First each block becomes a row, with the items from there on; those rows are dealt out anew. In its task, such a row meets every later block in turn. So a set of n items is spread over
    n / block rows, none of which ever holds more than the items themselves and block * block pairs.
    """
    size = F.size("items")
    starts = sets.select(*by, "items", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))).alias("_i"))
    tails = starts.select(*by, "_i", F.slice("items", F.col("_i") * block + 1, size).alias("_rest"))
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since the rows are small and their pairs aren't
    dealt = tails.repartition(tasks, "_i", F.col("_rest")[0])
    blocks = F.floor((F.size("_rest") - 1) / block).cast("int")
    met = dealt.select(*by, F.slice("_rest", 1, block).alias("_one"), "_rest", F.explode(F.sequence(F.lit(0), blocks)).alias("_j"))
    met = met.select(*by, "_one", "_j", F.slice("_rest", F.col("_j") * block + 1, block).alias("_other"))
    across = F.flatten(F.transform("_one", lambda x: F.transform("_other", lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return met.select(*by, F.explode(F.when(F.col("_j") == 0, pairs_in(F.col("_one"))).otherwise(across)).alias("p"))


def pair_counts(sets: DataFrame, by: list[str] | None = None, block: int = 512, alike: Column | None = None) -> DataFrame:
    """(by, a, b, n): in how many sets both items are. Sets of up to ``block`` items give their pairs in place; larger ones in blocks over many tasks. ``alike``: a condition on a and b; others aren't counted."""
    by = by or []
    some = sets.where(F.size("items") > 1)
    at = some.where(F.size("items") <= block).select(*by, "items", F.posexplode_outer("items").alias("_i", "a")).where(F.col("_i") < F.size("items") - 1)
    small = at.select(*by, "a", F.explode_outer(F.slice("items", F.col("_i") + 2, F.size("items"))).alias("b"))
    large = block_pairs(some.where(F.size("items") > block), by, block)
    both = small.union(large.select(*by, "p.a", "p.b"))
    return (both if alike is None else both.where(alike)).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def association(sets: DataFrame, stored: bool = False) -> DataFrame:
    """Per pair: n, na, nb, jaccard, lift, Fisher's right tail p, and q after Benjamini and Hochberg. The number of sets is one scalar.

    Sets (unless ``stored``) and measured pairs are staged, since ranks and margins need several passes over them.
    """
    sets = sets if stored else staged(sets, "sets")
    total = sets.count()
    freq = degrees(sets)
    pairs = (
        pair_counts(sets)
        .join(freq.select(F.col("item").alias("a"), F.col("degree").alias("na")), "a")
        .join(freq.select(F.col("item").alias("b"), F.col("degree").alias("nb")), "b")
        .where(F.lit(total) - F.col("na") - F.col("nb") + F.col("n") >= 0)
    )
    n, na, nb, all_ = F.col("n"), F.col("na"), F.col("nb"), F.lit(total).cast("bigint")
    measured = pairs.select(
        "a", "b", "n", "na", "nb", jaccard(n, na, nb).alias("jaccard"), lift(n, na, nb, all_).alias("lift"), fisher_right(n, na - n, nb - n, all_ - na - nb + n).alias("p")
    )
    return benjamini_hochberg(staged(measured, "pairs"))


def repeated_pairs(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs seen at least so often; a pair seen once has the highest measures by chance. Most significant first (ties: most frequent, then by name)."""
    return pairs.where(F.col("n") >= least).orderBy("q", F.desc("n"), "a", "b")


def support_counts(pairs: DataFrame, least: int = 2, level: float = 0.05) -> DataFrame:
    """One row: pairs, those seen at least so often, those seen less, and the significant ones."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") >= least).alias("repeated"), F.count_if(F.col("n") < least).alias("single"), F.count_if(F.col("q") < level).alias("significant"))


def never_together(items: DataFrame, pairs: DataFrame, item: str, freq: str, group: str, least: int = 3, placed: bool = False, chunk: int = 1024, block: int = 256) -> DataFrame:
    """(group, a, b, na, nb): pairs of frequent items of one group that no set holds. Groups are those of a taxonomy; pairs that were seen may be given with others.

    There are as many as items of a group squared, so neither they nor the rows of an item and a chunk of others are shuffled, staged or sorted on disk. What is moved are items and cells: a cell is a block of a group's
    items and a chunk of those that may come after them (``placed``: of one frequency). An item meets its block's cells in one task and becomes its pairs in the last step, by the places in the chunk between those that were seen.
    ``placed`` adds ``place``, from 1, most frequent items first (then by group, a and b): pairs are counted by block and sum of frequencies, and in a block by its earlier items.
    """
    known = items.where((F.col(freq) >= least) & F.col(item).isNotNull() & (F.coalesce(F.col(group).cast("string"), F.lit("")) != ""))
    ranked = _ranked(known.select(F.col(group).alias("group"), F.col(item).alias("b"), F.col(freq).alias("nb")), ["group", "nb"] if placed else ["group"], chunk, block)
    chunks = ranked.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_at", "b", "nb"))).alias("_s")).select("_k", F.col("_s.b").alias("_b"), F.col("_s.nb").alias("_nb"))
    # An item meets all chunks of its group: a row each, in as many tasks as keep them in memory.
    sizes = ranked.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("_k").alias("chunks"), F.sum(F.octet_length(F.col("b").cast("string")) + 16).alias("bytes"))
    rows, there, size = sizes.agg(F.sum(F.col("n") * F.col("chunks")), F.sum(F.col("n") * F.col("n")), F.sum("bytes")).first()
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows or 0) / TASK_ROWS), math.ceil((there or 0) / TASK_PAIRS))
    chunks = F.broadcast(chunks) if (size or 0) <= KNOWN_BYTES else chunks
    at = ["group", "_p"]
    one = ranked.select(*at, "_r", F.col("b").alias("a"), F.col("nb").alias("na"))
    # Where in the chunks an item's partners are.
    sides = pairs.select("a", "b").where("a < b").join(one.select("group", "a"), "a").join(ranked.select("group", "b", "_k", "_at"), ["group", "b"]).repartition("group", "a")
    met = sides.groupBy("group", "a", "_k").agg(F.array_sort(F.collect_set("_at")).alias("_met")).groupBy("group", "a").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_met"))).alias("_mets"))
    one, cells = one.join(met, ["group", "a"], "left"), _cells(ranked)
    start = F.col("_from") + F.coalesce(F.size(F.filter("_in", lambda x: x <= F.col("_r"))), F.lit(0))
    seen = F.coalesce(F.try_element_at("_mets", F.col("_k")), F.array().cast("array<int>"))
    if placed:
        one, cells = staged(one, "partners"), staged(cells, "cells")
        met_rows = one.repartition(tasks, *at).join(cells.repartition(tasks, *at), at)
        total = met_rows.groupBy(*at, (F.col("na") + F.col("nb")).alias("_sum")).agg(F.sum(F.col("_n") - start - F.size(seen)).alias("_left")).where("_left > 0")
        bases = running(total, [F.desc("_sum"), F.col("group"), F.col("_p")], "_left", "_before").select(*at, "_sum", "_before")
        # One more row of a block, without an item, meets what comes before the block by sum, so that it is there where the block's rows are summed.
        heads = ranked.select(*at).distinct()
        one = one.withColumn("_head", F.lit(0)).unionByName(heads.withColumn("_head", F.lit(1)), allowMissingColumns=True)
        cells = cells.withColumn("_base", F.lit(0)).unionByName(bases.withColumn("_base", F.lit(1)), allowMissingColumns=True)
    lines = one.repartition(tasks, *at).join(cells.repartition(tasks, *at), at)
    if placed:
        lines = lines.where("(_head + _base) % 2 = 0").withColumn("_sum", F.coalesce("_sum", F.col("na") + F.col("nb")))
    lines = lines.withColumn("_met", seen).withColumn("_first", start)
    if placed:
        lines = lines.withColumn("_left", F.coalesce("_before", F.col("_n") - F.col("_first") - F.size("_met"))).where("_left > 0 or _base = 1")
        inside = Window.partitionBy(*at, "_sum").orderBy(F.asc_nulls_first("_r"), "_k").rowsBetween(Window.unboundedPreceding, -1)
        lines = lines.select(*at, "_r", "a", "na", "_k", "_n", "_met", "_first", "_sum", "_left").withColumn("_before", F.sum("_left").over(inside)).where("_r is not null")
    # The places of a chunk between those of partners.
    gaps = lines.join(chunks, "_k").select("*", F.posexplode(F.concat("_met", F.array("_n"))).alias("_j", "_to"))
    gaps = gaps.withColumn("_gap", F.when(F.col("_j") == 0, F.col("_first")).otherwise(F.get("_met", F.col("_j") - 1) + 1)).where("_to > _gap")
    out = gaps.select("*", F.explode(F.sequence("_gap", F.col("_to") - 1)).alias("_i"))
    columns = ["group", "a", F.get("_b", "_i").alias("b"), "na", F.get("_nb", "_i").alias("nb")]
    return out.select(*columns, (F.col("_before") + F.col("_i") - F.col("_first") - F.col("_j") + 1).alias("place")) if placed else out.select(*columns)


def _ranked(items: DataFrame, by: list[str], chunk: int, block: int) -> DataFrame:
    """Items (group, b, nb), stored, with the place ``_r`` in the order of all, the block ``_p`` of their group, the chunk ``_k`` of those of equal ``by``, and the place ``_at`` in it, from 0. No group passes through one task."""
    some = numbered(items.orderBy("group", "b"), "_r")
    some = some.withColumn("_q", F.col("_r")) if by == ["group"] else numbered(some.orderBy(*by, "b"), "_q")
    some = some.withColumn("_p", F.floor(F.col("_r") / block)).withColumn("_c", F.floor(F.col("_q") / chunk))
    firsts = some.groupBy(*by, "_c").agg(F.min("_q").alias("_k"))
    return staged(some.join(firsts, [*by, "_c"]).select("group", "b", "nb", "_r", "_p", "_k", (F.col("_q") - F.col("_k")).cast("int").alias("_at")), "ranked")


def _cells(ranked: DataFrame) -> DataFrame:
    """(group, _p, _k, _n, _from, _in): for each block and each chunk of its group that doesn't end before it, the chunk's size, how many of it come before the block, and the places of those that are in the block."""
    inside = ranked.groupBy("group", "_p", "_k").agg(F.count("*").alias("_m"), F.array_sort(F.collect_list("_r")).alias("_in"))
    chunks = ranked.groupBy("group", "_k").agg(F.count("*").cast("int").alias("_n"), F.max("_p").alias("_last"), F.min("nb").alias("nb"))
    cells = ranked.select("group", "_p").distinct().join(chunks, "group").where("_last >= _p").join(inside, ["group", "_p", "_k"], "left")
    earlier = Window.partitionBy("group", "_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("group", "_p", "_k", "_n", "nb", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).cast("int").alias("_from"), "_in")


def crossing(pairs: DataFrame, groups: DataFrame, item: str, group: str, level: float = 0.05) -> DataFrame:
    """Significant pairs whose items belong to different groups; none counts as a group."""
    g = lambda side: groups.select(F.col(item).alias(side), F.coalesce(F.col(group).cast("string"), F.lit("")).alias(f"group_{side}"))
    out = pairs.where(F.col("q") < level).join(g("a"), "a", "left").join(g("b"), "b", "left")
    return out.na.fill("", ["group_a", "group_b"]).where("group_a <> group_b")


def network(rows: DataFrame, key: str, levels: dict[str, str], ambiguous: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, nodes and edges for each classification level, with and without ambiguous rows, from one pass over the rows.

    levels: name -> column. Versions: 'con' (all rows), 'sin' (without ambiguous ones).
    """
    pairs = [x for name, column in levels.items() for x in (F.lit(name), F.col(column).cast("string"))]
    long = rows.select(key, F.coalesce(F.col(ambiguous), F.lit(False)).alias("_amb"), F.explode(F.create_map(*pairs)).alias("level", "item")).where("item is not null and item <> ''")
    # Both versions from one aggregation: all items, and those that some unambiguous row has.
    both = long.groupBy("level", key).agg(F.array_sort(F.collect_set("item")).alias("con"), F.array_sort(F.collect_set(F.when(~F.col("_amb"), F.col("item")))).alias("sin"))
    versions = F.array(*(F.struct(F.lit(v).alias("version"), F.col(v).alias("items")) for v in ("con", "sin")))
    sets = both.select("level", key, F.explode(versions).alias("v")).select("level", key, "v.*").where(F.size("items") > 0)
    by = ["level", "version"]
    summary = sets.groupBy(*by).agg(F.count("*").alias("n_entities"), F.count_if(F.size("items") > 1).alias("n_multi"))
    return summary, degrees(sets, by), pair_counts(sets, by)


def named_nodes(nodes: DataFrame, names: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Nodes in the order of their codes, with a display name; codes without one show themselves."""
    known = names.groupBy(F.col(code).cast("string").alias("item")).agg(F.min(name).alias("_name"))
    return nodes.join(known, "item", "left").withColumn("label", F.coalesce("_name", "item")).drop("_name").orderBy("item")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Most frequent first, then by the pair."""
    return edges.orderBy(F.desc("n"), "a", "b")


def matrix(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long symmetric matrix: edges both ways and degrees on the diagonal."""
    by = by or []
    diagonal = nodes.select(*by, F.col("item").alias("a"), F.col("item").alias("b"), F.col("degree").alias("n"))
    return edges.select(*by, "a", "b", "n").union(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "n")).union(diagonal)


def top_partners(edges: DataFrame, k: int = 15) -> DataFrame:
    """For each item its k most frequent partners, ties by name."""
    both = edges.select(F.col("a").alias("item"), F.col("b").alias("partner"), "n").union(edges.select(F.col("b").alias("item"), F.col("a").alias("partner"), "n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def without_demand(targets: DataFrame, rows: DataFrame, item: str) -> DataFrame:
    """Targets that no row has."""
    return targets.select(item).distinct().join(rows.select(item), item, "left_anti")


def excluded(rows: DataFrame, n_items: str, kind: str, own: str = "programa_propio", upper: int = 30) -> DataFrame:
    """One row: rows of generic entities, rows that name a field only (generic ones are counted first), and rows that count."""
    generic = F.coalesce(F.col(n_items), F.lit(0)) > upper
    field = ~generic & ~F.coalesce(F.col(kind) == own, F.lit(False))
    return rows.agg(F.count_if(generic).alias("generic"), F.count_if(field).alias("field_only"), F.count_if(~generic & ~field).alias("counted"))


def cards(rows: DataFrame, key: str, item: str, origins: str, k: int = 15, catalog: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Per item: entities, its top co-items and top origin names as arrays, number of origins; most frequent first.

    catalog (item, levels: 'a | b', shares: 'a 30.8% | b 69.2%') adds the levels at which the item is taught, in the given order, and their shares.
    """
    sets = baskets(rows, key, item)
    partners = top_partners(pair_counts(sets), k).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "partner", "n"))).alias("partners"))
    names = rows.select(F.col(item).alias("item"), key, F.explode(origins).alias("origin")).where(F.trim("origin") != "").groupBy("item", "origin").agg(F.countDistinct(key).alias("n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "origin")
    ranked = names.withColumn("rank", F.row_number().over(w))
    top = ranked.groupBy("item").agg(F.count("*").alias("n_origins"), F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "origin", "n")))).alias("origins"))
    out = degrees(sets).withColumnRenamed("degree", "entities").join(partners, "item", "left").join(top, "item", "left")
    if catalog is not None:
        out = out.join(catalog.select("item", level_list(F.col("levels"), order or []).alias("levels"), level_shares(F.col("shares")).alias("shares")), "item", "left")
    return out.orderBy(F.desc("entities"), "item")


def items_per_level(cards: DataFrame, levels: str = "levels") -> DataFrame:
    """How many items are taught at each level; an item counts at each of its own."""
    return cards.select(F.explode(levels).alias("level")).groupBy("level").agg(F.count("*").alias("items"))
