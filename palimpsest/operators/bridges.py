"""Bridge tables from nested payloads: one row per (entity, item), last write wins, rows never expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.panel import latest


def bridge(df: DataFrame, key: str, items: Column, ord: Column, fields: dict[str, Column | str] | None = None, where: Column | None = None, carried: list[str] | None = None, with_order: bool = False) -> DataFrame:
    """(key, fields...) for each element of an array of structs or values, the last observation of each pair.

    ``fields`` maps output names to expressions over the element ``item``; the first is part of the key and must not be blank. ``with_order`` keeps
    the observation's order as ``ord``, for rows that later ones may replace.
    """
    fields = fields or {"item": F.col("item")}
    names = list(fields)
    carried = carried or []
    rows = df if where is None else df.where(where)
    rows = rows.select(key, *carried, ord.alias("_ord"), F.explode(items).alias("item"))
    rows = rows.select(key, *(F.col(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in fields.items()), *carried, "_ord")
    first = F.col(names[0])
    rows = rows.where(first.isNotNull() & (F.trim(first.cast("string")) != ""))
    rows = latest(rows, [key, names[0]], F.col("_ord"))
    return rows.withColumnRenamed("_ord", "ord") if with_order else rows.drop("_ord")


def declared_and_keyword(df: DataFrame, key: str, declared: Column, terms: Column, ok: Column, ord: Column) -> DataFrame:
    """Declared items (source 'declarada'); for entities without any, but with a good detail, their search terms ('keyword_only')."""
    n = F.coalesce(F.size(declared), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    # An observation has either declared items or terms: one pass over both. The outer form keeps the filter above.
    both = F.when(n > 0, declared).when(F.coalesce(ok, F.lit(False)), terms)
    rows = df.select(key, ord.alias("_ord"), n.alias("n_declared"), F.explode_outer(both).alias("_x")).where(F.col("_x").isNotNull() & ((F.col("n_declared") == 0) | (F.col("_x") != "")))
    given = F.col("n_declared") > 0
    rows = rows.select(key, F.when(given, F.col("_x")).alias("item"), F.when(~given, F.col("_x")).alias("term"), F.when(given, "declarada").otherwise("keyword_only").alias("source"), "n_declared", "_ord")
    return latest(rows, [key, "item", "term", "source"], F.col("_ord")).drop("_ord")


def item_sets(bridge_rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): the sorted distinct items of each entity."""
    return bridge_rows.where(F.col(item).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))


def co_declared(bridge_rows: DataFrame, key: str, item: str, chosen: Column) -> DataFrame:
    """Other items of the entities that have a chosen one, with the number of entities."""
    ids = bridge_rows.where(chosen).select(key).distinct()
    return bridge_rows.join(ids, key, "left_semi").where(~chosen).groupBy(item).agg(F.countDistinct(key).alias("n")).orderBy(F.desc("n"), item)


def specific_only(df: DataFrame, n_items: str, upper: int = 30) -> DataFrame:
    """Entities that declare at most ``upper`` items."""
    return df.where(F.coalesce(F.col(n_items), F.lit(0)) <= upper)


def clean_base(entities: DataFrame, bridge_rows: DataFrame, key: str, n_items: str, source: str = "source", upper: int = 30) -> DataFrame:
    """Specific entities that have a declared item."""
    declared = bridge_rows.where(F.col(source) == "declarada").select(key)
    return specific_only(entities, n_items, upper).join(declared, key, "left_semi")
