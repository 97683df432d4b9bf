"""Dates, numbers and small derivations as Column expressions. Nothing here fails on bad input: it gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import normalise

CONFIDENTIAL_NAMES = ("empresa confidencial", "confidencial")
NO_EXPERIENCE = "sin experiencia"


def date_iso(s: Column) -> Column:
    """Date at the start of 'yyyy-mm-dd...' or 'dd/mm/yyyy...'; null otherwise or off the calendar."""
    t = F.trim(s)
    iso = F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    day = F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}"), F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)))
    return F.coalesce(iso, day).try_cast("date")


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def period(d: Column) -> Column:
    return F.date_format(d, "yyyy_MM")


def int_or(v: Column, default: int = 0, via_float: bool = False) -> Column:
    """Whole number of a text; with via_float '945.0' counts as 945, else as the default."""
    t = F.trim(v.cast("string"))
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    return F.coalesce(t.try_cast("double").try_cast("bigint") if via_float else whole, F.lit(default).cast("bigint"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.try_divide(part, whole)


def experience(operator: Column, years: Column) -> Column:
    """struct(operator, years, inconsistent): null throughout if both are absent."""
    wrong = F.coalesce(F.startswith(normalise(operator), F.lit(NO_EXPERIENCE)) & (years > 0), F.lit(False))
    known = operator.isNotNull() | years.isNotNull()
    return F.struct(operator.alias("operator"), years.alias("years"), F.when(known, wrong).alias("inconsistent"))


def coordinates(pair: Column, text: Column) -> Column:
    """struct(lat, lon) from an array [lat, lon], else from 'lat,lon'."""
    split = F.split(text, ",")
    a, b = F.get(split, 0), F.get(split, 1)
    from_pair = F.when(F.size(pair) >= 2, F.struct(F.get(pair, 0).cast("double").alias("lat"), F.get(pair, 1).cast("double").alias("lon")))
    lat, lon = F.trim(a).try_cast("double"), F.trim(b).try_cast("double")
    return F.coalesce(from_pair, F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))))


def place(region: Column, town: Column, text: Column) -> Column:
    """struct(region, town): given ones, else the second and first part of 'town, region'."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    full = lambda c: F.nullif(c, F.lit(""))
    return F.struct(F.coalesce(full(region), F.get(parts, 1)).alias("region"), F.coalesce(full(town), F.get(parts, 0)).alias("town"))


def shown_salary(amount: Column, shown: Column) -> Column:
    return F.when(F.coalesce(shown, F.lit(False)) & (amount > 0), amount)


def is_confidential(has_detail: Column, flag: Column, name: Column) -> Column:
    return F.when(has_detail, F.coalesce(flag, F.lit(False))).otherwise(normalise(name).isin(*CONFIDENTIAL_NAMES))


def quality_of_duration(down: Column, first_state: Column, down_state: str) -> Column:
    """censurada: never seen down; cota_superior: already down when first seen; else observada."""
    return F.when(down.isNull(), "censurada").when(F.coalesce(first_state == down_state, F.lit(False)), "cota_superior").otherwise("observada")


def code_levels(code: Column) -> Column:
    """struct(broad, narrow, detailed) of a hierarchical code by its prefixes of 2, 3 and 4 characters."""
    n = F.char_length(code)
    return F.struct(
        F.when(n >= 2, F.substring(code, 1, 2)).alias("broad"), F.when(n >= 3, F.substring(code, 1, 3)).alias("narrow"), F.when(n >= 4, F.substring(code, 1, 4)).alias("detailed")
    )
