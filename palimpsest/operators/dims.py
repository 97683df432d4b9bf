"""Dimensions derived from observations, and the upsert that keeps hand-edited columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_dim(bridge_rows: DataFrame, observations: DataFrame, key: str, item: str, n_items: str, date: str, area: str, upper: int = 30) -> DataFrame:
    """Per item: distinct entities (all, specific), first and last seen, areas. observations has a row per (item, observation)."""
    # Two distinct counts at once would expand the rows and hold both copies; so each (item, entity) is one row first.
    each = bridge_rows.where(F.col(item).isNotNull()).groupBy(item, key).agg(F.bool_or(F.coalesce(F.col(n_items) <= upper, F.lit(False))).alias("_specific"))
    counts = each.groupBy(item).agg(F.count(key).alias("n_all"), F.count_if(F.col("_specific") & F.col(key).isNotNull()).alias("n_specific"))
    seen = observations.groupBy(item).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.array_sort(F.collect_set(area)).alias("areas"))
    return counts.join(seen, item, "left")


def ordered_items(items: DataFrame, item: str) -> DataFrame:
    """Items by how many specific entities declare them, then by all, then by name."""
    return items.orderBy(F.desc("n_specific"), F.desc("n_all"), item)


def canonical_names(observations: DataFrame, key: str, name: str, ord: Column, usable: Column) -> DataFrame:
    """Most frequent usable name per key (ties: first seen), and the counts of all. Counts by (key, name) come first, so a key isn't gathered."""
    each = observations.where(usable & F.col(name).isNotNull() & (F.col(name) != "")).groupBy(key, name).agg(F.count("*").alias("n"), F.min(ord).alias("first"))
    best = F.min_by(name, F.struct((-F.col("n")).alias("n"), F.col("first").alias("first")))
    return each.groupBy(key).agg(best.alias("canonical_name"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("n").alias("v"))))).alias("names"))


def company_dim(observations: DataFrame, entities: DataFrame, key: str, company: str, date: str, area: str, confidential: str) -> DataFrame:
    """Per company: distinct entities, first and last seen, areas; how many of its entities are confidential in their last state."""
    seen = observations.where(F.col(company).isNotNull()).groupBy(company).agg(
        F.countDistinct(key).alias("n_entities"), F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.array_sort(F.collect_set(area)).alias("areas")
    )
    hidden = entities.where(F.col(company).isNotNull()).groupBy(company).agg(F.count_if(F.col(confidential)).alias("n_confidential"))
    return seen.join(hidden, company, "left").withColumn("n_confidential", F.coalesce("n_confidential", F.lit(0)))


def first_of(observations: DataFrame, key: str, columns: list[str], ord: Column) -> DataFrame:
    """Each column's value in the key's first observation."""
    return observations.groupBy(key).agg(*(F.min_by(c, ord).alias(c) for c in columns))


def upsert_preserving_manual(new: DataFrame, previous: DataFrame | None, managed: list[str], key: str, order: Column | None = None) -> DataFrame:
    """Managed columns from ``new``; unknown columns of ``previous`` carried along by key; keys that vanished stay; blank keys go.

    Keys are compared as text. Of previous rows with one key the last counts, by ``order`` or else in the order in which they are read.
    """
    if previous is None or not previous.columns:
        return new.select(*managed)
    extra = [c for c in previous.columns if c not in managed]
    k = F.col(key).cast("string")
    placed = previous.select(F.struct(*previous.columns).alias("old"), k.alias("_k"), (F.monotonically_increasing_id() if order is None else order).alias("_at"))
    old = placed.where(F.trim("_k") != "").groupBy("_k").agg(F.max_by("old", "_at").alias("old"))
    fresh = new.select(F.struct(*managed).alias("new"), k.alias("_k"))
    both = fresh.join(old, "_k", "full_outer")
    present = F.col("new").isNotNull()
    kept = [F.when(present, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}") if c in previous.columns else F.lit(None)).alias(c) for c in managed]
    return both.select(*kept, *(F.col(f"old.{c}").alias(c) for c in extra))
