"""Crosswalks: free-text names to one or more destinations, attribution rows, coverage, suggestions, the editable queue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import join_key, normalise, tokens
from palimpsest.sources.raw import staged

SMALL_CATALOG, TASK_ROWS = 200_000, 500_000  # rows that every task may know; rows (entity, destination) of one task


def resolve(names: DataFrame, crosswalk: DataFrame, name: str, crosswalk_name: str, how: str = "inner") -> DataFrame:
    """All destinations of each name, joined on the spelling without case and repeated spaces. Spark broadcasts the crosswalk if it is small."""
    right = crosswalk.withColumn("_key", join_key(F.col(crosswalk_name)))
    clash = [c for c in right.columns if c in names.columns]
    return names.withColumn("_key", join_key(F.col(name))).join(right.drop(*clash), "_key", how).drop("_key")


def attribution(bridge_rows: DataFrame, crosswalk: DataFrame, programs: DataFrame, codes: DataFrame, key: str, item: str, mentions: int | None = None) -> DataFrame:
    """One row per (entity, destination): several-destinations flag, origin names, codes.

    A destination is a program (dropped if the catalog lacks it) or a field code (kept without levels if unknown).
    crosswalk: item, program, code, kind; programs: program, area, broad, narrow, detailed; codes: code.

    ``mentions``: how many rows bridge_rows has, if that is known. Then, if names and their destinations are at most ``SMALL_CATALOG`` rows, every task knows these: an entity's mentions are brought together
    before they become destinations, of which there are many more, in as many tasks as those need. Nothing but the mentions is shuffled.
    """
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    is_program = F.col("program").isNotNull()
    goal = F.when(is_program, F.col("program")).otherwise(F.concat(F.lit("isced:"), F.col("code")))
    keyed = crosswalk.select(join_key(F.col("item")).alias("_key"), full("program").alias("program"), full("code").alias("code"), "kind").withColumn("destination", goal)
    width = keyed.groupBy("_key").agg(F.count("*").alias("n_destinations"))
    # What a destination is: a table of the catalogs' size, apart from the mentions.
    known = programs.select("program", F.lit(True).alias("_known"), "area", "broad", "narrow", "detailed")
    ends = keyed.select("program", F.when(is_program, F.lit(None)).otherwise(F.col("code")).alias("code"), "destination").distinct().join(known, "program", "left").join(codes.select("code", F.lit(True).alias("_code")), "code", "left")
    ends = ends.where((is_program & F.col("_known")) | (~is_program & F.col("code").isNotNull()))
    prefix = lambda n: F.when(F.col("_code") & (F.char_length("code") >= n), F.substring("code", 1, n))
    ends = ends.select("destination", "program", F.when(is_program, F.col("area")).alias("area"), *(F.when(is_program, F.col(c)).otherwise(prefix(n)).alias(c) for n, c in ((2, "broad"), (3, "narrow"), (4, "detailed"))))
    ends = ends.groupBy("destination").agg(*(F.min(c).alias(c) for c in ("program", "area", "broad", "narrow", "detailed")))
    # Names get their destinations once each, then the mentions (without repeats) their names'.
    goals = keyed.join(width, "_key").join(ends.select("destination"), "destination", "left_semi").groupBy("_key", "destination").agg(F.min("kind").alias("kind"), F.bool_or(F.col("n_destinations") > 1).alias("_several"))
    said = bridge_rows.select(key, item)
    named = said.select(item).distinct().withColumn("_key", join_key(F.col(item))).join(goals, "_key").drop("_key")
    by_entity = [F.min_by("kind", item).alias("kind"), F.bool_or("_several").alias("ambiguous"), F.array_sort(F.collect_set(item)).alias("origins")]
    if mentions is not None:
        named, ends = staged(named, "named"), staged(ends, "ends")
        width, names, all_ends = *named.agg(F.count("*"), F.countDistinct(item)).first(), ends.count()
        if max(width, all_ends) <= SMALL_CATALOG:
            tasks = max(int(bridge_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(mentions * width / max(names, 1) / TASK_ROWS))
            kinds = named.groupBy("destination").agg(F.min("kind").alias("kind"), F.countDistinct(F.struct("kind")).alias("_kinds"))
            ends = staged(ends.join(kinds, "destination").coalesce(1).withColumn("_id", F.monotonically_increasing_id()), "numbered")
            goals = staged(named.join(ends.select("destination", "_id"), "destination").groupBy(item).agg(F.bool_or("_several").alias("_several"), F.collect_list("_id").alias("_goals")), "goals")
            rows = _met_destinations(said.repartition(tasks, key).distinct().join(F.broadcast(goals), item), key, item).join(F.broadcast(ends), "_id")
            if ends.where("_kinds > 1").limit(1).count():  # the kind is that of the first name, not the destination's
                rows = rows.drop("kind").join(F.broadcast(named.select(F.col(item).alias("_one"), "destination", "kind")), ["_one", "destination"])
            return rows.select(key, "destination", "program", "area", "broad", "narrow", "detailed", "kind", "ambiguous", "origins")
    hit = said.distinct().join(named, item)
    rows = hit.groupBy(key, "destination").agg(*by_entity)
    return rows.join(ends, "destination").select(key, "destination", "program", "area", "broad", "narrow", "detailed", "kind", "ambiguous", "origins")


def _met_destinations(mentions: DataFrame, key: str, item: str) -> DataFrame:
    """(key, _id, origins, ambiguous, _one): a row per entity and destination, with the names that lead there in order and the first of them. mentions: key, item, _several, _goals, without repeats, an entity's in one task.

    An entity's names become one array, sorted, and its hits another: numbers of destination, name and flag, in whose order each destination is a run. So nothing is kept or sorted by entity and destination.
    """
    bits = 1 + SMALL_CATALOG.bit_length()
    entities = mentions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(item, "_several", "_goals"))).alias("_e"))
    hits = F.transform("_e", lambda x, i: F.transform(x["_goals"], lambda g: F.shiftleft(g, bits) + i * 2 + x["_several"].cast("int")))
    arrays = entities.select(key, F.col(f"_e.{item}").alias("_names"), F.sort_array(F.flatten(hits)).alias("_hits"))
    to = lambda hit: F.shiftright(hit, bits)
    starts = F.filter(F.sequence(F.lit(0), F.size("_hits") - 1), lambda i: (i == 0) | (to(F.get("_hits", i)) != to(F.get("_hits", i - 1))))
    each = arrays.withColumn("_starts", starts).select("*", F.posexplode_outer("_starts").alias("_j", "_i"))  # outer, so that no filter on the array goes below and computes it again
    runs = each.select(key, "_names", F.slice("_hits", F.col("_i") + 1, F.coalesce(F.get("_starts", F.col("_j") + 1), F.size("_hits")) - F.col("_i")).alias("_run"))
    name = lambda hit: F.get("_names", F.shiftright(hit.bitwiseAND((1 << bits) - 1), 1).cast("int"))
    first = F.get("_run", 0)
    return runs.select(key, to(first).alias("_id"), F.transform("_run", name).alias("origins"), F.exists("_run", lambda x: x % 2 == 1).alias("ambiguous"), name(first).alias("_one"))


def coverage(mentions: DataFrame, crosswalk: DataFrame, item: str) -> DataFrame:
    """Mentions by outcome: resolved (a destination), no_program (only without), orphan (name unknown)."""
    known = crosswalk.groupBy(join_key(F.col("item")).alias("_key")).agg(F.bool_or(F.coalesce(F.trim("program"), F.lit("")) != "").alias("has_program"))
    state = F.when(F.col("has_program").isNull(), "orphan").when(F.col("has_program"), "resolved").otherwise("no_program")
    return mentions.withColumn("_key", join_key(F.col(item))).join(known, "_key", "left").groupBy(state.alias("outcome")).agg(F.count("*").alias("mentions"), F.countDistinct(item).alias("names"))


def orphans(mentions: DataFrame, crosswalk: DataFrame, item: str, n: int = 10) -> DataFrame:
    """Most mentioned names that the crosswalk lacks."""
    known = crosswalk.select(join_key(F.col("item")).alias("_key"))
    rest = mentions.withColumn("_key", join_key(F.col(item))).join(known, "_key", "left_anti")
    return rest.groupBy(item).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), item).limit(n)


def catalog_rows(nested: DataFrame) -> DataFrame:
    """(area, term, name, ordinal) from the catalog's nested form: areas in order, each with a map of terms to names in order. nested: place, area, entries (array of term and name).

    A term that an area repeats counts with its last name, in its first place, as in a map.
    """
    rows = nested.select("place", "area", F.posexplode("entries").alias("at", "e")).select("place", "area", "at", "e.term", "e.name")
    once = rows.groupBy("place", "area", "term").agg(F.max_by("name", "at").alias("name"), F.min("at").alias("at"))
    return once.select("area", "term", "name", F.struct("place", "at").alias("ordinal"))


def catalog_index(catalog: DataFrame) -> DataFrame:
    """Per term: name (of the first area), sorted areas, and whether areas disagree on the name. catalog: area, term, name, ordinal."""
    return catalog.groupBy("term").agg(
        F.min_by("name", "ordinal").alias("name"), F.array_sort(F.collect_set("area")).alias("areas"), (F.countDistinct("name") > 1).alias("conflict"), F.bool_or(F.col("term") != F.col("name")).alias("renamed")
    )


def map_terms(terms: DataFrame, catalog: DataFrame, term: str) -> DataFrame:
    """Terms with name and areas of the catalog, and whether they are in it."""
    index = catalog_index(catalog).select(F.col("term").alias(term), "name", "areas", F.lit(True).alias("_in"))
    return terms.join(index, term, "left").withColumn("mapped", F.coalesce("_in", F.lit(False))).drop("_in")


def _prefixes(sets: DataFrame, freq: DataFrame, common: int) -> DataFrame:
    """sets(_id, _t) with their tokens in one order for all, rarest first (``_w``), how many those are (``_n``), and from which place on they are common (``_from``)."""
    known = sets.select("_id", F.explode("_t").alias("_w")).join(freq, "_w", "left").select("_id", F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_w").alias("w")).alias("_s"))
    ordered = known.groupBy("_id").agg(F.array_sort(F.collect_list("_s")).alias("_s"))  # a set's own tokens
    return ordered.select("_id", F.transform("_s", lambda s: s["w"]).alias("_w"), F.size("_s").alias("_n"), F.size(F.filter("_s", lambda s: s["f"] <= common)).alias("_from"))


def _overlapping(a: DataFrame, b: DataFrame, n: Column, m: Column, floor: float) -> DataFrame:
    """Rows of a and b that share a token of both prefixes, once a pair, with ``_both`` shared tokens and ``_score``. Sides bring _id, _w, _i (place), _token and sizes n and m."""
    needed = F.ceil(floor / (1 + floor) * (n + m) - 1e-9)  # shared tokens that a pair of such sizes needs
    pairs = a.join(b, F.col("a._token") == F.col("b._token")).where((F.col("a._i") <= n - needed) & (F.col("b._i") <= m - needed))
    shared = F.array_intersect("a._w", "b._w")
    pairs = pairs.withColumn("_shared", shared).where(F.element_at("_shared", 1) == F.col("a._token")).withColumn("_both", F.size("_shared"))
    return pairs.withColumn("_score", F.col("_both") / (n + m - F.col("_both")))


def best_matches(left: DataFrame, right: DataFrame, floor: float, common: int = 64) -> DataFrame:
    """(_id, _best, _score) of left(_id, _t): the row of right(_id, _ord, _t) with the highest Jaccard similarity of their token sets from ``floor`` on, the least _ord on ties.

    Sets are ordered rarest token first. Sets of n and m tokens that are similar enough share k(n, m) = ceil(floor / (1 + floor) * (n + m)) of them, so that their first common token is among
    the first n - k + 1 and m - k + 1: only those are joined, and a pair is measured where that first common token is met. Tokens of more than ``common`` rows of right are never joined row by row. Pairs that
    share rarer tokens meet at those. For pairs that share common tokens only, the score depends on nothing but the common tokens and the sizes, so it is computed between the distinct
    (common tokens, size) of either side, with the least _ord of each: the number of those grows with the vocabulary of common tokens, not with the rows. A row that shares a rarer token as well has more than that score,
    and is found with it.
    """
    freq = right.select(F.explode("_t").alias("_w")).groupBy("_w").agg(F.count("*").alias("_f"))
    ordinals = right.select("_id", "_ord")
    a, b = (_prefixes(side.select("_id", "_t"), freq, common) for side in (left, right))
    b = b.join(ordinals, "_id")
    # Rare tokens, row by row. A set alone needs at least ceil(floor * n) common tokens.
    own = lambda n: n - F.ceil(floor * n - 1e-9)
    spread = lambda side: side.select("*", F.posexplode(F.slice("_w", 1, F.least(F.col("_from"), (own(F.col("_n")) + 1).cast("int")))).alias("_i", "_token"))
    some = lambda side: side.where("_from > 0")
    rare = _overlapping(spread(some(a)).alias("a"), spread(some(b)).alias("b"), F.col("a._n"), F.col("b._n"), floor)
    rare = rare.select(F.col("a._id").alias("_id"), F.col("b._id").alias("_best"), F.col("b._ord").alias("_ord"), "_score")
    # Common tokens, between distinct sets of them.
    ends = lambda side: side.where("_from < _n").select("*", F.slice("_w", F.col("_from") + 1, F.col("_n")).alias("_c")).drop("_w")
    of_left, of_right = ends(a), ends(b).groupBy("_c", "_n").agg(F.min_by(F.struct("_id", "_ord"), "_ord").alias("_r"))
    kinds = of_left.select("_c", "_n").distinct()
    spread_ends = lambda side: side.select("*", F.col("_c").alias("_w"), F.posexplode("_c").alias("_j", "_token")).withColumn("_i", F.col("_n") - F.size("_c") + F.col("_j"))
    met = _overlapping(spread_ends(kinds).alias("a"), spread_ends(of_right).alias("b"), F.col("a._n"), F.col("b._n"), floor)
    met = met.where(F.col("_score") >= floor).groupBy(F.col("a._c").alias("_c"), F.col("a._n").alias("_n")).agg(F.max_by(F.struct("b._r", "_score"), F.struct(F.col("_score"), -F.col("b._r._ord"))).alias("_m"))
    shared = of_left.join(met, ["_c", "_n"]).select("_id", F.col("_m._r._id").alias("_best"), F.col("_m._r._ord").alias("_ord"), F.col("_m._score").alias("_score"))
    both = rare.where(F.col("_score") >= floor).unionByName(shared)
    return both.groupBy("_id").agg(F.max_by(F.struct("_best", "_score"), F.struct(F.col("_score"), -F.col("_ord"))).alias("_m")).select("_id", "_m.*")


def suggest(names: DataFrame, catalog: DataFrame, name: str, canon: str, ordinal: str, floor: float = 0.30, common: int = 64) -> DataFrame:
    """(name, suggestion, score): the catalog entry with the highest token Jaccard, first entry on ties, from ``floor`` on (more than 0). See ``best_matches``."""
    left = names.select(F.col(name).alias("_id")).where(F.col(name).isNotNull()).distinct().withColumn("_t", tokens(F.col("_id"), 2))
    entries = catalog.groupBy(F.col(canon).alias("_id")).agg(F.min(ordinal).alias("_ord"))  # repeated entries count once, as their first
    best = best_matches(left, entries.withColumn("_t", tokens(F.col("_id"), 2)), floor, common)
    return best.select(F.col("_id").alias(name), F.col("_best").alias("suggestion"), F.bround("_score", 2).alias("score"))


def exact_match(names: DataFrame, catalog: DataFrame, name: str, canon: str, ordinal: str) -> DataFrame:
    """names with ``exact``: the catalog entry with the same normalised name (the first of several), else null."""
    index = catalog.groupBy(normalise(F.col(canon)).alias("_n")).agg(F.min_by(canon, ordinal).alias("exact"))
    return names.withColumn("_n", normalise(F.col(name))).join(index, "_n", "left").drop("_n")


def queue(observed: DataFrame, catalog: DataFrame, previous: DataFrame, name: str, level: str, weight: str, decision: str, canon: str, ordinal: str) -> DataFrame:
    """The editable queue: a row per (name, level or '*'), decisions and other columns of before kept, exact matches filled in only
    where there is no decision, suggestions for what is still open, vanished rows kept. Open rows first, heaviest first."""
    old = previous.withColumn(level, F.coalesce(F.nullif(F.trim(level), F.lit("")), F.lit("*"))).withColumnRenamed(weight, "_old_weight")
    fresh = observed.where(F.coalesce(F.trim(name), F.lit("")) != "").select(name, weight, F.lit(True).alias("_seen"))
    both = fresh.join(old, name, "full_outer").withColumn(level, F.coalesce(level, F.lit("*")))
    both = exact_match(both, catalog, name, canon, ordinal)
    given = F.nullif(F.trim(decision), F.lit(""))
    auto = F.col("_seen") & given.isNull() & F.col("exact").isNotNull()
    both = both.withColumn("auto", F.coalesce(auto, F.lit(False))).withColumn(decision, F.coalesce(given, F.when(F.col("_seen"), F.col("exact"))))
    both = both.withColumn(weight, F.coalesce(weight, "_old_weight")).withColumn("kept", F.col("_seen").isNull())
    hints = suggest(both.where(F.col(decision).isNull() & F.col("_seen")), catalog, name, canon, ordinal)
    done = both.join(hints, name, "left")
    open_ = F.col(decision).isNull() & ~F.col("kept")
    for c in ("suggestion", "score"):
        done = done.withColumn(c, F.when(open_, F.col(c)))
    return done.drop("_seen", "_old_weight", "exact").orderBy(F.col(decision).isNotNull(), F.desc_nulls_last(weight), name, level)


def queue_summary(rows: DataFrame, decision: str, weight: str) -> DataFrame:
    """Automatic, decided before, kept and open rows, and the share of weight that is decided."""
    open_ = F.col(decision).isNull()
    return rows.agg(
        F.count("*").alias("rows"), F.count_if("auto").alias("auto"), F.count_if(~open_ & ~F.col("auto") & ~F.col("kept")).alias("already"), F.count_if("kept").alias("kept"),
        F.count_if(open_).alias("pending"), F.sum(F.when(~open_, F.col(weight)).otherwise(0)).alias("decided_weight"), F.sum(weight).alias("weight"),
    )


def top_per_group(df: DataFrame, by: list[str], count: str, name: str, k: int = 15) -> DataFrame:
    """The k rows of each group with the highest count, ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), name)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
