"""Benchmark decontamination: SimHashes of item-sized windows in a multi-index of Hamming blocks, then exact verification.

Words are runs of letters and digits, lower-cased; a shingle is five words (an item with fewer is one
shingle of its own length). Windows have an item's number of words. Its similarity to the item is the weight of the shared
shingles over that of all (as multisets); a shingle weighs log(1 + items / items that have it), one of no item as if one had it.

Three steps, none of which loses a match:

1. Windows are laid where they can match anything at all. A shared shingle stands on a diagonal (its place in the document less that in the item). If
   all the shared shingles of a window lie on diagonals beyond its beginning, moving it a word towards them loses none and can't lower its
   similarity. So the best window begins on a diagonal or between two of the same stretch, or as near to them as the document's ends
   allow. Windows are laid at every diagonal, at every place between neighbouring diagonals that are at most an item's length apart, and, where these
   reach beyond an end of the document, both cut off there and moved inside. Those around which the shared
   shingles together weigh too little to reach the similarity are left out.
2. Each different window has a 64-bit SimHash and meets, through the multi-index, every item of its length within ``radius`` bits, whatever item it was laid for. These pairs are verified
   exactly. A window found equal to an item settles that text and item.
3. Windows of similarity 0.8 can lie beyond any radius that is worth an index, so those of texts and items that aren't settled are verified
   against the item whose diagonal they lie on.

Texts and items are compared by content, so that copies cost nothing: a text's MD5 stands for it. Null or empty texts match
nothing. Of equal windows the first counts; for each document and item the best window is reported. Repeated ids are reported once
(the best window of all), null ids count as one id. Extra columns don't matter. DataFrame expressions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, lookup_join, materialize

#: The benchmark's shingles are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SHINGLES = 500_000
#: Other tables are broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20
#: Distance of SimHashes within which the multi-index finds every pair, and the blocks that it cuts them into.
RADIUS = 11
_BLOCKS = 4
#: Neighbouring windows that are cut out together.
_PIECE = 64
NOT_WORDS = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS), "")


def _hashed(text: Column) -> Column:
    """A hash of each word."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _grams(hashes: Column, size: int | Column) -> Column:
    """Hashes of all shingles; none if there are fewer words."""
    n = F.size(hashes) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(size) if isinstance(size, int) else size)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """Signed 64-bit fingerprint: a bit is set if more than half of the hashes have it."""
    bit = lambda b: F.aggregate(grams, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int")) * 2 > F.size(grams)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.struct(b.alias("b"), bit(b).alias("on")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: F.when(x["on"], s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["b"]))).otherwise(s))


def _text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def within_radius(windows: DataFrame, items: DataFrame, radius: int, salts: int = 4) -> DataFrame:
    """All pairs (window, item) of one length whose fingerprints differ in at most radius bits, by a multi-index. windows: window, length, fp; items: item, length, fp.

    Fingerprints are cut into four blocks, one of which holds at most a fourth of the differences. Each side enters its blocks with every value that half of
    these flips reach, so that the two meet between them: 68 keys for a window and for an item at radius 11. Rows without a fingerprint or length meet nothing.
    """
    width, reach = 64 // _BLOCKS, radius // _BLOCKS

    def keys(rows: DataFrame, name: str, fp: str, flips: int) -> DataFrame:
        masks = F.array(*(F.lit(sum(1 << b for b in bits)).cast("bigint") for k in range(flips + 1) for bits in combinations(range(width), k)))
        blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), width * i).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i in range(_BLOCKS)))
        each = rows.select(name, "length", fp, F.explode(blocks).alias("x")).select(name, "length", fp, "x.*", F.explode(masks).alias("mask"))
        return each.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")

    asked = keys(windows, "window", "fp", reach // 2)
    index = keys(items.withColumnRenamed("fp", "item_fp"), "item", "item_fp", reach - reach // 2)
    on = ["length", "block", "value"]
    if index.count() <= BROADCAST_SHINGLES:
        index = F.broadcast(index)
    else:  # a common value is dealt out; Spark's own estimate of the sizes doesn't see the keys
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("window"), F.lit(salts)).cast("int"))
        index, on = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), [*on, "salt"]
    return asked.join(index, on).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("window", "item").distinct()


def leaks_by_text(texts: DataFrame, items: DataFrame, similarity: float, shingle: int, radius: int = RADIUS) -> DataFrame:
    """One row per (key, item) that match: first_word, n_words, hamming, similarity. texts: key, text; items: item, text; both keys stand for a content."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = items.select("item", _hashed(F.col("text")).alias("hashes")).where(F.size("hashes") > 0).repartition(parts, "item")
    items = items.select("item", "hashes", F.size("hashes").alias("length"), F.least(F.lit(shingle), F.size("hashes")).alias("size"))
    items = materialize(items.withColumn("grams", _grams(F.col("hashes"), F.col("size"))).withColumn("fp", simhash(F.col("grams"))).drop("hashes"), "items")
    sizes = items.groupBy("size").agg(F.count("*"), F.sum(F.size("grams"))).collect()  # five rows at most
    n_items, n_shingles = sum(r[1] for r in sizes), sum(r[2] for r in sizes)
    each = items.select("item", "size", F.explode("grams").alias("gram")).groupBy("item", "size", "gram").agg(F.count("*").alias("m"))
    weights = each.groupBy("size", "gram").agg(F.log(1 + n_items / F.count("*")).alias("w"))
    each = materialize(each.join(weights, ["size", "gram"]), "item-shingles")
    heavy = each.groupBy("item").agg(F.sum(F.col("w") * F.col("m")).alias("item_weight"))
    items = items.join(heavy, "item")
    seeds = items.select("item", "size", "length", "item_weight", F.posexplode("grams").alias("at", "gram")).join(each.select("item", "gram", "w"), ["item", "gram"])
    if n_shingles <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)

    # Shared shingles, then diagonals. The outer form of explode, because a filter on the array's size would be pushed below it and compute everything twice.
    hits = None
    for size in sorted(r[0] for r in sizes):
        numbered = F.transform(_grams(F.col("hashes"), size), lambda g, i: F.struct(g.alias("gram"), i.alias("p")))
        placed = texts.select("key", _hashed(F.col("text")).alias("hashes")).select("key", F.explode_outer(numbered).alias("g")).select("key", "g.gram", "g.p")
        found = placed.join(seeds.where(F.col("size") == size), "gram").select("key", "item", "length", "item_weight", (F.col("p") - F.col("at")).alias("begin"), "p", "w")
        hits = found if hits is None else hits.union(found)
    result = "key string, item string, first_word int, n_words int, hamming int, similarity double"
    if hits is None:
        return texts.sparkSession.createDataFrame([], result)
    diagonals = hits.distinct().groupBy("key", "item", "length", "item_weight", "begin").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("key", "item").orderBy(F.col("begin") / F.col("length"))
    around = F.sum("w").over(order.rangeBetween(-2, 2))
    gap = F.lead("begin").over(order) - F.col("begin")
    near = diagonals.withColumn("around", around).withColumn("gap", F.coalesce(F.when(gap <= F.col("length"), gap), F.lit(1)))
    near = near.where(F.col("around") >= (similarity - 1e-9) * F.col("item_weight"))
    # Places in a row are one stretch, so that a text which repeats one word has few.
    order = Window.partitionBy("key", "item").orderBy(F.col("begin") / F.col("length"))
    apart = F.coalesce(F.lag(F.col("begin") + F.col("gap")).over(order) != F.col("begin"), F.lit(True))
    stretches = near.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = stretches.groupBy("key", "item", "length", "stretch").agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("gap")).alias("end"))
    per_text = materialize(stretches.groupBy("key").agg(F.collect_list(F.struct("item", "length", "begin", "end")).alias("places")), "places")

    # The windows' words, from the texts that have places.
    weight = 64 + F.size("places") * 60
    words = lookup_join(texts, per_text, "key", weight, BROADCAST_BYTES).where("places is not null").dropDuplicates(["key"])
    words = words.select("key", _hashed(F.col("text")).alias("hashes"), "places")
    # Windows that reach beyond an end of the text are also laid inside it: at its first place, at the last that holds a whole window.
    last = lambda x: F.greatest(F.lit(0), F.size("hashes") - x["length"])
    stretch = lambda x, b, e: F.struct(x["item"].alias("item"), x["length"].alias("length"), b.alias("begin"), e.alias("end"))
    at_start = F.transform(F.filter("places", lambda x: x["begin"] < 0), lambda x: stretch(x, F.lit(0), F.lit(1)))
    at_end = F.transform(F.filter("places", lambda x: x["end"] - 1 > F.size("hashes") - x["length"]), lambda x: stretch(x, last(x), last(x) + 1))
    # Stretches go in pieces, each with its own words, so that no row holds all windows of a text.
    step = F.lit(_PIECE)
    cut = lambda x: F.transform(F.sequence(x["begin"], x["end"] - 1, step), lambda b: stretch(x, b, F.least(b + step, x["end"])))
    begin = lambda b: F.greatest(b, F.lit(0))
    lent = lambda x: F.slice("hashes", begin(x["begin"]) + 1, F.greatest(F.lit(0), x["end"] - 1 + x["length"] - begin(x["begin"])))
    pieces = F.transform(F.flatten(F.transform(F.concat("places", at_start, at_end), cut)), lambda x: F.struct(x.alias("of"), lent(x).alias("words")))
    pieces = words.select("key", F.explode_outer(pieces).alias("x")).select("key", "x.of.*", "x.words")
    part = lambda b: F.slice("words", begin(b) - begin(F.col("begin")) + 1, F.least(F.col("length"), F.col("length") + b))
    laid = F.transform(F.sequence(F.col("begin"), F.col("end") - 1), lambda b: F.struct(begin(b).alias("first_word"), part(b).alias("part")))
    windows = pieces.select("key", "item", "length", F.least(F.lit(shingle), F.col("length")).alias("size"), F.explode_outer(laid).alias("x")).select("key", "item", "length", "size", "x.*")
    content = F.struct("length", F.md5(F.array_join("part", " ")).alias("words"))
    windows = materialize(windows.select("key", "item", "length", "first_word", F.size("part").alias("n_words"), _grams(F.col("part"), F.col("size")).alias("grams"), "size", content.alias("window")), "windows")
    places = windows.select("key", "item", "first_word", "n_words", "window")
    different = windows.groupBy("window").agg(F.first("length").alias("length"), F.first("size").alias("size"), F.first("grams").alias("grams"))
    different = materialize(different.withColumn("fp", simhash(F.col("grams"))), "contents")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (window, item) that are similar enough, with distance and similarity."""
        counted = different.join(pairs, "window").select("window", "item", "size", F.explode("grams").alias("gram")).groupBy("window", "item", "size", "gram").agg(F.count("*").alias("c"))
        counted = counted.join(each.select("item", "gram", "m"), ["item", "gram"], "left").join(weights, ["size", "gram"], "left")
        w = F.coalesce("w", F.log(F.lit(1.0 + n_items)))
        sums = counted.groupBy("window", "item").agg(F.sum(w * F.least("c", F.coalesce("m", F.lit(0)))).alias("shared"), F.sum(w * F.col("c")).alias("total"))
        sums = sums.join(items.select("item", "item_weight", F.col("fp").alias("item_fp")), "item").join(different.select("window", "fp"), "window")
        good = sums.withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_weight") - F.col("shared"))).where(F.col("similarity") >= similarity - 1e-12)
        return good.select("window", "item", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming"), "similarity")

    close = materialize(verified(within_radius(different, items, radius)), "close")
    # A window equal to an item is the best there can be, and all others like it are in the radius too: only the other pairs' diagonals are left.
    settled = places.join(close.where(F.col("similarity") >= 1 - 1e-9).select("window", F.col("item").alias("equal")), "window").select("key", F.col("equal").alias("item")).distinct()
    rest = places.join(settled, ["key", "item"], "left_anti").select("window", "item").distinct().join(close, ["window", "item"], "left_anti")
    good = materialize(close.union(verified(rest)).groupBy("window").agg(F.collect_list(F.struct("item", "hamming", "similarity")).alias("good")), "verified")
    matched = lookup_join(places.drop("item"), good, "window", 96 + F.size("good") * 64, BROADCAST_BYTES).where("good is not null")
    matched = matched.select("key", "first_word", "n_words", F.explode("good").alias("x")).select("key", "first_word", "n_words", "x.*")
    best = F.max_by(F.struct("first_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("first_word")))
    return matched.groupBy("key", "item").agg(best.alias("best")).select("key", "item", "best.*")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    shingle: int = 5,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per (document, item) that match: id, item, first_word, n_words, hamming, similarity."""
    named = benchmark.select(F.col(item_col).alias("id"), F.md5(F.array_join(_words(F.col(item_text_col)), " ")).alias("item"), F.col(item_text_col).alias("text"))
    items = named.groupBy("item").agg(F.first("text").alias("text"))
    texts = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    found = leaks_by_text(texts, items, similarity, shingle, radius)
    item_ids = named.groupBy("item").agg(F.collect_set(F.struct("id")).alias("ids"))
    found = lookup_join(found, item_ids, "item", 64 + F.size("ids") * 24, BROADCAST_BYTES)
    found = found.select("key", F.struct("ids", "first_word", "n_words", "hamming", "similarity").alias("x"))
    per_text = materialize(found.groupBy("key").agg(F.collect_list("x").alias("found")), "leaks")
    ids = docs.select(F.col(id_col).alias("doc"), _text_key(text_col).alias("key"))
    rows = lookup_join(ids, per_text, "key", 64 + F.size("found") * 96, BROADCAST_BYTES).where("found is not null")
    rows = rows.select("doc", F.explode("found").alias("x")).select("doc", F.explode("x.ids").alias("item"), "x.*").select("doc", F.col("item.id").alias("item"), "first_word", "n_words", "hamming", "similarity")
    best = F.max_by(F.struct("first_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("first_word")))
    return rows.groupBy("doc", "item").agg(best.alias("best")).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """docs without the documents that hold an item."""
    items = benchmark.select(F.md5(F.array_join(_words(F.col(item_text_col)), " ")).alias("item"), F.col(item_text_col).alias("text")).groupBy("item").agg(F.first("text").alias("text"))
    texts = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    key, leak = free_name(docs, "_key"), free_name(docs, "_leak")
    leaks = materialize(leaks_by_text(texts, items, similarity, shingle, radius).select(F.col("key").alias(key)).distinct(), "leaks")
    marked = lookup_join(docs.withColumn(key, _text_key(text_col)), leaks.withColumn(leak, F.lit(True)), key, F.lit(80), BROADCAST_BYTES)
    return marked.where(F.col(leak).isNull()).select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "first_word", "n_words", "hamming", "similarity")
