"""Quality blocks: thresholds, templates, concentration, drift, term diagnostics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import all_tokens_match, tokens


def size_distribution(df: DataFrame, n_items: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(n_items), F.lit(0)).alias("n_items")).agg(F.count("*").alias("entities"))


def threshold_gap(df: DataFrame, n_items: str, upper: int = 30) -> DataFrame:
    """Largest size up to the threshold, next one above, sizes just above it, and whether there is a gap."""
    return size_distribution(df, n_items).withColumnRenamed("n_items", "_n").agg(
        F.max(F.when(F.col("_n") <= upper, F.col("_n"))).alias("max_below"),
        F.min(F.when(F.col("_n") > upper, F.col("_n"))).alias("next_above"),
        F.count_if((F.col("_n") > upper) & (F.col("_n") < 3 * upper)).alias("sizes_just_above"),
        (F.count_if((F.col("_n") > upper) & (F.col("_n") < 3 * upper)) == 0).alias("gap"),
    )


def generic_by_owner(df: DataFrame, n_items: str, owner: str, title: str, ord: Column, upper: int = 30, k: int = 8) -> DataFrame:
    """Owners of the most generic entities, with the first title as an example."""
    generic = df.where(F.coalesce(F.col(n_items), F.lit(0)) > upper)
    return generic.groupBy(owner).agg(F.count("*").alias("n"), F.min_by(title, ord).alias("example")).orderBy(F.desc("n"), owner).limit(k)


def reused_sets(df: DataFrame, set_hash: str, n_items: str, owner: str, upper: int = 30, floor: int = 10) -> DataFrame:
    """Sets that more than one entity has: how many, their size, owners (a missing one counts), templates (one owner), blind templates."""
    out = df.where(F.col(set_hash).isNotNull() & (F.col(set_hash) != "")).groupBy(set_hash).agg(
        F.count("*").alias("n"), F.max(n_items).alias("size"), F.countDistinct(F.coalesce(F.col(owner).cast("string"), F.lit(""))).alias("owners")
    )
    one = F.col("owners") == 1
    return out.where("n > 1").withColumn("template", one).withColumn("blind", one & (F.col("size") >= floor) & (F.col("size") <= upper))


def concentration(df: DataFrame, owner: str, areas: str | None = None, alarm: float = 0.25) -> DataFrame:
    """Shares of the top 1, 3 and 10 owners, over all and per area; entities without owner count in the base. Total and areas are separate sums, since an entity may have several areas."""
    whole = df.select(F.lit("*").alias("scope"), F.col(owner).alias("_o"))
    if areas:
        whole = whole.union(df.select(F.explode(areas).alias("scope"), F.col(owner).alias("_o")))
    base = whole.groupBy("scope").agg(F.count("*").alias("n"))
    counts = whole.where("_o is not null").groupBy("scope", "_o").agg(F.count("*").alias("c"))
    w = Window.partitionBy("scope").orderBy(F.desc("c"), "_o")
    top = counts.withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("scope").agg(*(F.sum(F.when(F.col("r") <= k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in (1, 3, 10)))
    out = base.join(top, "scope")
    return out.select("scope", "n", *((F.col(f"c{k}") / F.col("n")).alias(f"top{k}") for k in (1, 3, 10)), (F.col("c1") / F.col("n") > alarm).alias("alarm"))


def catalog_drift(terms: DataFrame, key: str, term: str, mapped: str) -> DataFrame:
    """Unmapped terms with the entities that have them."""
    return terms.where(~F.coalesce(F.col(mapped), F.lit(False))).groupBy(term).agg(F.countDistinct(key).alias("entities"))


def term_diagnostics(terms: DataFrame, entities: DataFrame, declared: DataFrame, key: str, term: str, title: str, item: str, n_items: str, owner: str, upper: int = 30, noise: float = 0.25, one: float = 0.30) -> DataFrame:
    """Per term: entities, share with the term in the title, share of the specific ones with a matching declared item, share of the top owner, flag."""
    facts = entities.select(key, title, n_items, F.col(owner).alias("_owner"))
    rows = terms.select(key, term).join(facts, key, "left").withColumn("_t", tokens(F.col(term), 3))
    rows = rows.withColumn("_in_title", F.coalesce(all_tokens_match(F.col("_t"), tokens(F.col(title), 3)), F.lit(False))).withColumn("_specific", F.coalesce(F.col(n_items), F.lit(0)) <= upper)
    # An entity's items are gathered, so that all tables meet at its key and no pair of a term and an item becomes a row.
    items = declared.where(F.col(item).isNotNull()).groupBy(key).agg(F.collect_set(item).alias("_items"))
    rows = rows.join(items, key, "left").withColumn("_match", F.exists("_items", lambda x: all_tokens_match(F.col("_t"), tokens(x, 3))))
    base = rows.groupBy(term).agg(
        F.count("*").alias("n"),
        F.avg(F.col("_in_title").cast("int")).alias("in_title"),
        F.try_divide(F.count_if(F.col("_specific") & F.coalesce("_match", F.lit(False))), F.count_if(F.col("_specific"))).alias("in_items"),
    )
    owners = rows.where("_owner is not null").groupBy(term, "_owner").agg(F.count("*").alias("c")).groupBy(term).agg(F.max("c").alias("top"))
    out = base.join(owners, term, "left").withColumn("top1", F.coalesce(F.col("top") / F.col("n"), F.lit(0.0))).drop("top")
    quiet = (F.col("in_title") < noise) & (F.col("in_items").isNull() | (F.col("in_items") < noise))
    return out.withColumn("flag", F.when(quiet, "ruido").when(F.col("top1") > one, "1 empleador"))


def cumulative_coverage(items: DataFrame, name: str, count: str, ranks: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """Share of all mentions that the top items cover, for each rank."""
    total = items.agg(F.sum(count)).first()[0]
    rows = [items.orderBy(F.desc(count), name).limit(r).agg(F.lit(r).alias("top"), F.sum(count).alias("covered")) for r in ranks]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.select("top", "covered", F.try_divide(F.col("covered"), F.lit(total)).alias("share"))


def shared_set_summary(sets: DataFrame, k: int = 5) -> DataFrame:
    """The k most shared sets; sets: as from reused_sets."""
    return sets.orderBy(F.desc("n"), F.desc("size"), sets.columns[0]).limit(k)


def ordered_templates(sets: DataFrame) -> DataFrame:
    """Templates (one owner), largest first, then most frequent."""
    return sets.where("template").orderBy(F.desc("size"), F.desc("n"), sets.columns[0])


def shared_set_totals(sets: DataFrame) -> DataFrame:
    """How many sets are shared, and the entities they cover."""
    return sets.agg(F.count("*").alias("sets"), F.sum("n").alias("entities"))


def consolidation_summary(entities: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: entities, and how many satisfy each condition."""
    return entities.agg(F.count("*").alias("entities"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def recoverable(entities: DataFrame, owner: str, name: str, confidential: str) -> DataFrame:
    """How many confidential entities have an owner whose name is known from another."""
    named = entities.where(F.col(name).isNotNull()).select(owner).distinct()
    return entities.where(F.col(confidential)).join(named, owner, "left_semi").agg(F.count("*").alias("recoverable"))


def capture_counters(raw: DataFrame, by: list[str], ok: Column, down: Column) -> DataFrame:
    return raw.groupBy(*by).agg(F.count("*").alias("done"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(down).alias("deactivated"))
