"""Lookups: search by name, profile of a chosen item, filters on cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normalise


def search_names(rows: DataFrame, name: str, key: str, n_items: str, query: str, upper: int = 30) -> DataFrame:
    """Names that contain the text, without regard to marks and case, with their specific entities (zero is kept)."""
    needle = normalise(F.lit(query))
    hit = rows.where(F.col(name).isNotNull() & normalise(F.col(name)).contains(needle))
    return hit.groupBy(name).agg(F.countDistinct(F.when(F.coalesce(F.col(n_items), F.lit(0)) <= upper, F.col(key))).alias("n_specific")).orderBy(F.desc("n_specific"), name)


def find_name(names: DataFrame, name: str, query: str, k: int = 15) -> DataFrame:
    """(name, match): equal normalised names; if there are none, the first k that contain the text."""
    needle = normalise(F.lit(query))
    known = names.select(name).distinct().withColumn("_n", normalise(F.col(name)))
    exact = known.where(F.col("_n") == needle).withColumn("match", F.lit("exact"))
    if exact.limit(1).count():
        return exact.select(name, "match")
    return known.where(F.col("_n").contains(needle)).withColumn("match", F.lit("similar")).select(name, "match").orderBy(name).limit(k)


def facets(df: DataFrame, columns: dict[str, Column], k: int = 15) -> DataFrame:
    """(facet, value, n, share, rank): the most frequent values of several columns from one pass."""
    total = Window.partitionBy("facet")
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for f, c in columns.items())))
    counts = df.select(each.alias("v")).groupBy(F.col("v.facet").alias("facet"), F.col("v.value").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lookup_profile(entities: DataFrame, rows: DataFrame, key: str, item: str, chosen: str, columns: dict[str, Column], k: int = 15) -> DataFrame:
    """Facets of the entities that have the item."""
    ids = rows.where(F.col(item) == chosen).select(key)
    return facets(entities.join(ids, key, "left_semi"), columns, k)


def filter_cards(cards: DataFrame, area: str | None = None, field: str | None = None, level: str | None = None, text: str | None = None) -> DataFrame:
    """Cards of an area, a narrow field, a level, or with a text in their name or in an origin name."""
    out = cards
    if area:
        out = out.where(F.col("area") == area)
    if field:
        out = out.where(F.col("narrow") == field)
    if level:
        out = out.where(F.array_contains("levels", level))
    if text:
        needle = normalise(F.lit(text))
        out = out.where(normalise(F.col("item")).contains(needle) | F.exists("origin_names", lambda o: normalise(o).contains(needle)))
    return out
