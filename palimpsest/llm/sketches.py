"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range.

Words are the lower-cased text cut at white space; a shingle is five words (a shorter text is one
shingle, a text without words has none). A shingle's hash is a 32-bit value; the sketch keeps all
distinct hashes below 2**32 / scale. Since the threshold doesn't depend on the document, sketches of
parts unite into the sketch of the whole, and the containment of a short text in a very long one can be
estimated from their sketches alone. Texts of at most ``exact_below`` different shingles keep every hash (scale 1), so that texts with
few of them don't end up with empty sketches; two sketches are compared at the coarser of their two scales.

A fingerprint is written ``scale:`` and the hashes in hex, ascending. Null texts count as empty; two
sketches without hashes are alike (1) if the fingerprints are equal and else unlike (0). Everything
here is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import free_name, materialize

SCALE = 8
EXACT_BELOW = 128
_RANGE = 1 << 32
#: Groups of neighbours: a row of two numbers each, 3 MB.
_MOST_GROUPS = 1 << 17


def with_sketch(df: DataFrame, text_col: str, out: str, words: int = 5, scale: int = SCALE, exact_below: int = EXACT_BELOW) -> DataFrame:
    """df with the struct ``out``: scale int, hashes array<long> (ascending, distinct)."""
    w, h = free_name(df, "_words"), free_name(df, "_hashes")
    split = F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    n = F.size(w)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))),
        lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col(w), i, F.lit(words))), 32),
    )
    df = df.withColumn(h, F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(h, F.array_distinct(h))
    few = F.size(h) <= exact_below
    kept = F.when(few, F.col(h)).otherwise(F.filter(h, lambda x: x < _RANGE // scale))
    sketch = F.struct(F.when(few, 1).otherwise(scale).alias("scale"), F.array_sort(kept).alias("hashes"))
    return df.withColumn(out, sketch).drop(w, h)


def fingerprint(sketch: Column) -> Column:
    """The sketch as text; equal texts have equal fingerprints."""
    return F.concat_ws(
        ":", sketch["scale"].cast("string"), F.array_join(F.transform(sketch["hashes"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    )


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hashes of a, of b, and of both, at the coarser scale."""
    scale = F.greatest(a["scale"], b["scale"])
    at = lambda s: F.when(s["scale"] == scale, s["hashes"]).otherwise(F.filter(s["hashes"], lambda x: x < F.lit(_RANGE) / scale))
    return F.size(at(a)), F.size(at(b)), F.size(F.array_intersect(at(a), at(b)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    na, nb, both = _shared(a, b)
    return F.when(na + nb > 0, both / (na + nb - both)).otherwise((a == b).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    na, _, both = _shared(a, b)
    return F.when(na > 0, both / na).otherwise((a == b).cast("double"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together, at the coarser scale."""
    scale = F.greatest(a["scale"], b["scale"])
    both = F.array_union(a["hashes"], b["hashes"])
    kept = F.when(a["scale"] == b["scale"], both).otherwise(F.filter(both, lambda x: x < F.lit(_RANGE) / scale))
    return F.struct(scale.alias("scale"), F.array_sort(kept).alias("hashes"))


def _code_of_texts(df: DataFrame, column: str, cells: int = 1024, each: int = 20) -> Column:
    """A number that never falls along the order of texts, and differs for most of them even if they begin alike.

    Cuts from a sample of at most ``cells * each`` texts (those with the least hashes) part the texts into stretches of the order; the code is the stretch, and the six bytes after those that
    all texts of the stretch have in common (which its least and greatest text tell).
    """
    known = df.where(F.col(column).isNotNull())
    sample = sorted((r[0] for r in known.select(column).orderBy(F.xxhash64(column)).limit(cells * each).collect()), key=lambda t: t.encode())
    cuts = sorted({sample[len(sample) * k // cells] for k in range(1, cells)} if sample else set(), key=lambda t: t.encode())
    step = math.isqrt(len(cuts)) + 1
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda q: q < F.col(column)))
    cell = coarse * step + F.size(F.filter(F.slice(array(cuts), coarse * step + 1, F.lit(step)), lambda q: q < F.col(column)))
    ends = {r[0]: (r[1].encode(), r[2].encode()) for r in known.groupBy(cell.alias("c")).agg(F.min(column), F.max(column)).collect()}  # a row per stretch
    alike = [next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high))) for low, high in (ends.get(c, (b"", b"")) for c in range(len(cuts) + 1))]
    skip = F.element_at(F.array(*map(F.lit, alike)), cell + 1)
    after = F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), skip + 1, F.lit(6))), 12, "0"), 16, 10).cast("bigint")
    return cell.cast("bigint") * F.lit(1 << 48) + after


def _place(df: DataFrame, id_col: str, carried: list[str]) -> Column:
    """A whole number that never falls along the order of ids: the id itself, or a code of a text; missing ids below, by the first bytes of the first carried text."""
    start = lambda c: F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), F.lit(1), F.lit(7))), 14, "0"), 16, 10).cast("bigint")
    kind, least = df.schema[id_col].dataType, F.lit(-(1 << 62))
    if isinstance(kind, T.StringType):
        known = _code_of_texts(df, id_col)
    else:
        known = F.greatest(F.col(id_col).cast("bigint") if isinstance(kind, T.IntegralType) else F.floor(F.col(id_col).cast("double")).cast("bigint"), least)
    late = F.coalesce(start(F.col(carried[0])), F.lit(0)) if isinstance(df.schema[carried[0]].dataType, T.StringType) else F.lit(0)
    return F.coalesce(known, least - 1 - late)


def with_next(df: DataFrame, id_col: str, carried: list[str], prefix: str = "next_", rows_per_group: int = 64, cells: int = 1024) -> DataFrame:
    """Each row with the carried columns of the next row by descending id; after the last comes the first.

    Ids go into groups that follow each other (percentiles, then equal widths), so that no group holds
    more than a small share of the ids. There is a group for every ``rows_per_group`` rows, up to ``_MOST_GROUPS``; beyond that, groups grow with the rows. One shuffle by group brings neighbours together. The first
    row of a group also goes, as a guest, to the end of the group before it: a table of one row for each group tells which, small enough for every task to have it, so that the texts move once. Ids may be numbers or texts (dates as
    numbers); texts are told apart by the bytes after what their neighbourhood has in common. Equal ids are ordered by the carried columns; missing ids come last.
    """
    place, g, guest, late = (free_name(df, n) for n in ("_place", "_group", "_guest", "_late"))
    df = df.withColumn(place, _place(df, id_col, carried))
    total, least, most = df.agg(F.count("*"), F.min(place), F.max(place)).first()
    if not total:
        return df.select(*(c for c in df.columns if c != place), *(F.col(c).alias(prefix + c) for c in carried))
    cells = max(1, min(cells, total // rows_per_group))
    cuts = df.agg(F.percentile_approx(place, [i / cells for i in range(1, cells)], 10_000)).first()[0] if cells > 1 else []
    edges = sorted({*cuts, most})
    lows = [least, *(e + 1 for e in edges[:-1])]
    per, step = max(1, min(total // rows_per_group, _MOST_GROUPS) // cells), math.isqrt(len(edges)) + 1
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    # The cell of an id: first the stretch of cells, then the cell in it.
    stretch = F.size(F.filter(array(edges[step - 1 :: step]), lambda q: q < F.col(place)))
    cell = F.least(stretch * step + F.size(F.filter(F.slice(array(edges), stretch * step + 1, F.lit(step)), lambda q: q < F.col(place))), F.lit(len(edges) - 1))
    cell_name = free_name(df, "_cell")
    df = df.withColumn(cell_name, cell)
    low, high = F.element_at(array(lows), F.col(cell_name) + 1), F.element_at(array(edges), F.col(cell_name) + 1)
    part = F.least(F.floor((F.col(place) - low) / (high.cast("double") - low + 1) * per), F.lit(per - 1)).cast("bigint")
    df = df.withColumn(g, F.col(cell_name) * F.lit(per).cast("bigint") + part).drop(cell_name)
    # Per group its first place, and the group before it, which has that place's rows as guests; the last group has those of the first.
    firsts = materialize(df.groupBy(g).agg(F.max(place).alias("place")), "groups")
    first_group, last_group = firsts.agg(F.max(g), F.min(g)).first()
    before = F.coalesce(F.lag(g).over(Window.orderBy(F.desc(g))), F.lit(last_group))  # a row of two numbers per group, _MOST_GROUPS in all
    hosts = firsts.select(F.col("place").alias(place), before.alias(guest))
    rows = df.join(F.broadcast(hosts), place, "left")
    places = F.array(F.struct(F.lit(0).alias("late"), F.col(g).alias("g")), F.struct(F.lit(1).alias("late"), F.col(guest).alias("g")))
    rows = rows.withColumn(late, F.explode(F.filter(places, lambda p: p["g"].isNotNull()))).withColumn(g, F.col(late)["g"]).withColumn(late, F.col(late)["late"]).drop(guest)
    order = Window.partitionBy(g).orderBy(F.col(late), F.desc_nulls_last(id_col), *carried)
    for c in carried:
        rows = rows.withColumn(prefix + c, F.lead(c).over(order))
    return rows.where(F.col(late) == 0).drop(g, late, place)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(with_sketch(docs, "text", "sketch"), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    near = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    near = with_sketch(near, "edited", "edited_sketch")
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return near.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"),
        resemblance(own, following).alias("near_next"),
        containment(own, edited).alias("contained_in_edited"),
        containment(own, following).alias("contained_in_next"),
    )
