"""Profiles: fill rates, keys of raw JSON with evidence, schema drift, files present and missing."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with stripped column names, and the names that weren't clean."""
    return df.toDF(*(c.strip() for c in df.columns)), [c for c in df.columns if c != c.strip()]


def _filled(c: str, kind: str) -> Column:
    col = F.col(f"`{c}`")
    return col.isNotNull() if kind.startswith(("array", "map", "struct", "binary")) else (F.trim(col.cast("string")) != "")


def fill_rates(df: DataFrame) -> DataFrame:
    """(column, rows, filled, share): cells that aren't null or blank, from one pass over the table."""
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(_filled(c, t), F.lit(False))).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(df.columns)))
    return sums.select("n", F.explode(each).alias("v")).select(F.col("v.column").alias("column"), F.col("n").alias("rows"), F.col("v.filled").alias("filled"), F.try_divide("v.filled", "n").alias("share"))


def is_filled_json(v: Column) -> Column:
    return v.isNotNull() & ~v.isin("", "[]", "{}")


def json_keys(df: DataFrame, payloads: dict[str, Column], examples: int = 6, width: int = 90, cap: int = 400) -> DataFrame:
    """(level, key, n_records, filled, share, distinct_values, examples) of every key in JSON object texts.

    The share's base is all records. Distinct values (their first 200 characters) are counted up to the cap; pairs of
    key and value are counted first, so that a common key isn't gathered.
    """
    total = df.count()
    entries = None
    for level, json in payloads.items():
        part = df.select(F.lit(level).alias("level"), F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
        entries = part if entries is None else entries.union(part)
    values = entries.withColumn("ok", is_filled_json(F.col("value"))).groupBy("level", "key", "ok", F.substring("value", 1, 200).alias("v")).agg(F.count("*").alias("n"))
    good = values.where("ok")
    w = Window.partitionBy("level", "key").orderBy(F.desc("n"), "v")
    shown = good.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("level", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("v", 1, width).alias("v")))), lambda s: s["v"]).alias("examples"))
    counts = values.groupBy("level", "key").agg(F.sum("n").alias("n_records"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("filled"), F.least(F.count_if("ok"), F.lit(cap + 1)).alias("distinct_values"))
    return counts.join(shown, ["level", "key"], "left").withColumn("share", F.col("filled") / F.lit(total))


def _key_states(cap: int, examples: int, flush: int = 1_000_000):
    """Batches of (level, key, ok, v, ord) to one task's states: (level, key, n, filled, v, first), a row with the counts and at most cap + 1 values for each key.

    Distinct values are kept up to cap + 1, and of all values the few with the least ord, which take the places of others. States of many keys are emitted before the end; they merge like those of other tasks.
    """

    def run(batches):
        counts: dict[tuple, list[int]] = {}
        values: dict[tuple, set] = {}
        first: dict[tuple, dict] = {}

        def emit():
            rows = [(*k, n, filled, None, None) for k, (n, filled) in counts.items()]
            for k, seen in values.items():
                shown = first[k]
                others = [v for v in seen if v not in shown][: cap + 1 - len(shown)]
                rows += [(*k, 0, 0, v, shown.get(v)) for v in (*shown, *others)]
            counts.clear(), values.clear(), first.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["level", "key", "n", "filled", "v", "first"])

        for batch in batches:
            pdf = batch.to_pandas()
            for k, n, filled in pdf.groupby(["level", "key"])["ok"].agg(["size", "sum"]).itertuples(name=None):
                c = counts.setdefault(k, [0, 0])
                c[0], c[1] = c[0] + int(n), c[1] + int(filled)
            least = pdf[pdf["ok"]].groupby(["level", "key", "v"])["ord"].min().reset_index().sort_values("ord")
            for k, own in least.groupby(["level", "key"]):
                seen, shown = values.setdefault(k, set()), first.setdefault(k, {})
                for v in own["v"]:
                    if len(seen) > cap:
                        break
                    seen.add(v)
                for v, o in own[["v", "ord"]].head(examples).itertuples(index=False, name=None):
                    shown[v] = min(o, shown.get(v, o))
                for v in sorted(shown, key=shown.get)[examples:]:
                    del shown[v]
            if sum(map(len, values.values())) + len(counts) > flush:
                yield emit()
        yield emit()

    return run


def key_profile(df: DataFrame, payloads: dict[str, Column], ord: Column, examples: int = 6, width: int = 90, cap: int = 400) -> DataFrame:
    """(level, key, n_records, filled, share, distinct_values, examples) as ``json_keys``, but with the values that come first (by ``ord``, a whole number) as examples.

    Those can be told without counting every value, so that a key of free text or of ids isn't shuffled: each task keeps a bounded state for a key, at most cap + 1 values leave it, and the states are united.
    """
    total = df.count()
    entries = None
    placed = df.withColumn("_ord", ord.cast("bigint"))
    for level, json in payloads.items():
        part = placed.select(F.lit(level).alias("level"), "_ord", F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
        entries = part if entries is None else entries.union(part)
    rows = entries.select("level", "key", F.coalesce(is_filled_json(F.col("value")), F.lit(False)).alias("ok"), F.substring("value", 1, 200).alias("v"), F.col("_ord").alias("ord"))
    states = rows.mapInArrow(_key_states(cap, examples), "level string, key string, n bigint, filled bigint, v string, first bigint")
    values = states.where("v is not null").groupBy("level", "key", "v").agg(F.min("first").alias("first"))
    w = Window.partitionBy("level", "key").orderBy("first", "v")
    top = values.where("first is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    shown = top.groupBy("level", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("v", 1, width).alias("v")))), lambda s: s["v"]).alias("examples"))
    distinct = values.groupBy("level", "key").agg(F.least(F.count("*"), F.lit(cap + 1)).alias("distinct_values"))
    counts = states.where("v is null").groupBy("level", "key").agg(F.sum("n").alias("n_records"), F.sum("filled").alias("filled"))
    out = counts.join(distinct, ["level", "key"], "left").join(shown, ["level", "key"], "left")
    return out.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0))).withColumn("share", F.col("filled") / F.lit(total))


def find_keys(profile: DataFrame, text: str) -> DataFrame:
    """Keys whose name contains the text."""
    return profile.where(F.lower("key").contains(text.lower()))


def schema_drift(df: DataFrame, table: str, declared: list[str], manual: list[str] | None = None, glossed: list[str] | None = None) -> DataFrame:
    """(table, column, origin, documented): code, manual, unexpected or absent columns, and glosses without a column."""
    manual, have = manual or [], {c.strip() for c in df.columns}
    rows = [(table, c, "code" if c in have else "absent", glossed is None or c in glossed) for c in declared]
    rows += [(table, c, "manual" if c in manual else "unexpected", glossed is None or c in glossed) for c in df.columns if c.strip() not in declared]
    rows += [(table, c, "orphan gloss", True) for c in glossed or [] if c not in have and c not in declared]
    return df.sparkSession.createDataFrame(rows, "`table` string, `column` string, origin string, documented boolean")


def drift_report(df: DataFrame, table: str, declared: list[str], manual: list[str] | None = None, glossed: list[str] | None = None) -> DataFrame:
    """The drift of a table's columns with how full each is: rows and filled cells (null for columns that aren't there)."""
    return schema_drift(df, table, declared, manual, glossed).join(fill_rates(df).select("column", "rows", "filled"), "column", "left")


def undocumented(profile: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """Keys of a profile that the documentation lacks, with their evidence."""
    return profile.join(known.select(key), key, "left_anti")


def tables_present(found: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    """(name, status): present, missing or unknown."""
    both = found.select(name, F.lit(True).alias("_f")).join(expected.select(name, F.lit(True).alias("_e")), name, "full_outer")
    return both.select(name, F.when(F.col("_f") & F.col("_e"), "present").when(F.col("_e"), "missing").otherwise("unknown").alias("status"))


def first_lines(df: DataFrame, file: str, seq: str, n: int) -> DataFrame:
    """The first n rows of each file."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy(seq))).where(F.col("_r") <= n).drop("_r")


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of each table."""
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def profile(masters: dict[str, DataFrame], raw: DataFrame, payloads: dict[str, Column], declared: dict[str, list[str]], manual: dict[str, list[str]], documented: list[str]) -> dict[str, DataFrame]:
    """The whole profile: shapes and fill rates of the masters, drift of their columns, tables present, keys of the raw payloads and those that nothing documents."""
    spark = raw.sparkSession
    keys = json_keys(raw, payloads)
    known = spark.createDataFrame([(k,) for k in documented], "key string")
    names = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "name string")
    return {
        "shapes": shapes(masters),
        "fill": reduce(DataFrame.union, (fill_rates(df).select(F.lit(name).alias("table"), "*") for name, df in masters.items())),
        "drift": reduce(DataFrame.union, (schema_drift(df, name, declared.get(name, []), manual.get(name)) for name, df in masters.items())),
        "tables": tables_present(names(masters), names(declared)),
        "keys": keys,
        "undocumented": undocumented(keys, known),
    }
