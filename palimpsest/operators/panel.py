"""Folding an observation log into one row per entity.

Observations have a total order ``ord`` (a struct stored at ingest, see sources.raw); every "first" and
"last" goes by it. All states are mergeable (counts, extremes, sets, min_by/max_by pairs), so that batches
give what a full replay gives. Each fold is one aggregation with map-side partial sums on the entity key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import days_between, quality_of_duration


def latest(df: DataFrame, keys: list[str], ord: Column) -> DataFrame:
    """Last write wins: the whole last row of each key."""
    payload = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), ord).alias("_row")).select(*keys, "_row.*") if payload else df.select(*keys).distinct()


def latest_by_rank(df: DataFrame, keys: list[str], ord: Column) -> DataFrame:
    """The same by a window, for rows with map columns and the like that cannot be aggregated."""
    w = Window.partitionBy(*keys).orderBy(ord.desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def partial_panel(df: DataFrame, key: str, date: str, ord: Column, state: str, down_state: str, sets: dict[str, Column]) -> DataFrame:
    """Mergeable states per entity: first and last state carry their order; ``sets`` are arrays to unite."""
    aggregates = [
        F.min(date).alias("first_seen"),
        F.max(date).alias("last_seen"),
        F.count("*").alias("n_seen"),
        F.min(F.struct(ord.alias("ord"), F.struct(F.col(state).alias("state")).alias("v"))).alias("first_state_at"),
        F.max(F.struct(ord.alias("ord"), F.struct(F.col(state).alias("state")).alias("v"))).alias("last_state_at"),
        F.min(F.when(F.col(state) == down_state, F.col(date))).alias("down_on"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(v)))).alias(n) for n, v in sets.items()),
    ]
    return df.groupBy(key).agg(*aggregates)


def merge_panels(states: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """One state per entity from several (old state and batches, in any order)."""
    return states.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n_seen").alias("n_seen"),
        F.min("first_state_at").alias("first_state_at"),
        F.max("last_state_at").alias("last_state_at"),
        F.min("down_on").alias("down_on"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in sets),
    )


def finish_panel(states: DataFrame, down_state: str, published: Column | None = None) -> DataFrame:
    """Readable columns: states without their order, real runs, duration and its quality class."""
    first, last = F.col("first_state_at.v.state"), F.col("last_state_at.v.state")
    begin = F.col("first_seen") if published is None else published
    return (
        states.withColumn("first_state", first)
        .withColumn("last_state", last)
        .withColumn("duration_quality", quality_of_duration(F.col("down_on"), first, down_state))
        .withColumn("censored", F.col("down_on").isNull())
        .withColumn("days_until_down", days_between(begin, F.col("down_on")))
        .drop("first_state_at", "last_state_at")
    )


def index_quantiles(df: DataFrame, value: str, by: list[str] | None = None, ranges: int = 200) -> DataFrame:
    """p25, median, p75 and max picked by index n//4, n//2, 3n//4 from the sorted values (not interpolated).

    Selection by counting: approximate quantiles a little below and above each of the three places (by 1 / (50 * ranges) of the rows) cut a group's values into seven ranges. Rows are counted by range, before the shuffle, which tells for
    certain in which range each place lies; only the values of those ranges are counted one by one and ranked. Three passes over two columns; what is shuffled is a row per range, and about 3 / (25 * ranges) of the values.
    """
    key, at, places = "_group", F.col(value), (0.25, 0.5, 0.75)
    rows = df.where(at.isNotNull()).select(at.alias(value), (F.struct(*by) if by else F.struct(F.lit(1).alias("all"))).alias(key))
    near = [q + sign / (50 * ranges) for q in places for sign in (-1, 1)]
    cuts = rows.groupBy(key).agg(F.percentile_approx(value, near, 100 * ranges).alias("_cuts"), F.count("*").alias("n"), F.max(value).alias("maximum"))
    part = sum(((F.col("_cuts")[i] < at).cast("int") for i in range(len(near))), F.lit(0))
    sized = rows.join(cuts.select(key, "_cuts"), key).groupBy(key, part.alias("_part")).agg(F.count("*").alias("_size"))
    w = Window.partitionBy(key).orderBy("_part")  # at most seven rows
    bounds = sized.withColumn("_to", F.sum("_size").over(w)).withColumn("_from", F.col("_to") - F.col("_size")).join(cuts, key)
    index = [F.floor(F.col("n") * k / 4) for k in (1, 2, 3)]
    held = [(F.col("_from") <= i) & (i < F.col("_to")) for i in index]
    wanted = bounds.where(held[0] | held[1] | held[2])
    # The rows of those ranges: above the cut below, up to the cut above.
    low, high = F.when(F.col("_part") > 0, F.col("_cuts")[F.col("_part") - 1]), F.when(F.col("_part") < len(near), F.col("_cuts")[F.col("_part")])
    wanted = wanted.select(key, "_from", "n", "maximum", low.alias("_low"), high.alias("_high"))
    inside = rows.join(wanted, key).where((F.col("_low").isNull() | (at > F.col("_low"))) & (F.col("_high").isNull() | (at <= F.col("_high"))))
    values = inside.groupBy(key, "_from", value).agg(F.count("*").alias("_k"), F.max("n").alias("n"), F.max("maximum").alias("maximum"))
    to = F.sum("_k").over(Window.partitionBy(key, "_from").orderBy(value)) + F.col("_from")
    ranked = values.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_k"))
    pick = [F.max(F.when(h, at)).alias(name) for h, name in zip(held, ("p25", "p50", "p75"), strict=True)]
    out = ranked.groupBy(key).agg(F.max("n").alias("n"), *pick, F.max("maximum").alias("maximum"))
    return out.select(*(F.col(key)[c].alias(c) for c in by or []), "n", "p25", "p50", "p75", "maximum")


def panel_summary(panel: DataFrame) -> DataFrame:
    """How many were seen again, and how many have each duration quality."""
    return panel.agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("n_seen") > 1).alias("seen_again"),
        *(F.count_if(F.col("duration_quality") == q).alias(q) for q in ("censurada", "cota_superior", "observada")),
    )


def with_multiplicity(df: DataFrame, column: str, out: str = "multiplicity") -> DataFrame:
    """How many rows share the value; null values have none. Counts are aggregated first, so a common value isn't gathered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(out))
    return df.join(counts, column, "left").select(*[c for c in df.columns if c != out], out)
