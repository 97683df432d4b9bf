"""Exact repeats of long strings: sparse suffixes, merged from front-coded sorted runs.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same text or another. Beside that,
the words of passages of 50 or more words that another text has, too, are counted (words are cut at ASCII white space).
Both come from the same steps, over the bytes of a text or over its words, each a 32-bit number:

1. Texts are brought together by content (equal texts are wholly repeated) and written as a table bucketed by
   content key, so that the two later joins don't move the texts again.
2. Of every window of ``length`` symbols, the leftmost ``gram`` symbols of least hash are its anchor. Equal windows
   have their anchor at the same place, so only the suffixes that start at anchors are compared: about
   one for every 180 bytes. Anchors whose windows have the same symbols throughout (by a 128-bit BLAKE2b digest) are counted together:
   they repeat, and one stands for all from here on. Those whose own gram then occurs once drop out.
3. Each task sorts the suffixes it holds (the symbols from the anchor on as far as its windows reach, then those before it, backwards) and
   sends them front-coded, a run for each range of anchor hashes. The receiver merges the runs with a loser tree that keeps
   each player's common prefix with the last winner: of two players the one with the longer common prefix wins unseen,
   and equal ones are compared from there on.
4. The merged order and its common prefixes tell which windows repeat: a window that begins d symbols before its anchor is that of
   another suffix if both are in one stretch of the order with common prefixes of ``length`` - d or more, and in one stretch of
   the same kind in the order of the symbols before the anchor, backwards, with d or more. So the symbols themselves are compared, not hashes.
   A range holds a bounded number of bytes on average. Grams with more than ``hot`` different surroundings (each takes some
   2 KB of working memory) don't enter it: their windows become rows, each with its digest, which Spark counts with map-side sums.
5. Runs of repeated window starts go back to the texts, bucket to bucket.

Null texts count as empty, texts shorter than ``length`` have no windows, and repeated rows are repeats.
Matches never cross texts. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, lookup_join, materialize, note_table, only_result, own_tables, shared_dir

_BLOCK = 2 << 20  # symbols that are hashed together
_POSITION = (1 << 24) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACES = 1 << 12
_PLACE = np.cumprod(np.full(_PLACES, _BASE, dtype=np.uint64), dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: bytes) -> np.ndarray:
    """A 32-bit hash of each word of a text."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data[at:end], dtype=np.uint8)
        full = np.flatnonzero(~_SPACE[part])
        first = np.flatnonzero(np.diff(full, prepend=-2) > 1)  # in full: where words begin
        if len(first):
            within = np.arange(len(full)) - np.repeat(first, np.diff(np.append(first, len(full))))
            # Long words: places from _PLACES on take the multipliers again, turned.
            value = _TABLE[part[full]] * _PLACE[within % _PLACES] * ((within // _PLACES).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            out.append(((np.add.reduceat(value, first) * _BASE) >> np.uint64(32)).astype(np.uint32))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


@dataclass(frozen=True)
class Unit:
    """What texts are made of: bytes or words; the length of windows and of anchors; whether only other texts count."""

    of_words: bool
    length: int
    gram: int
    across: bool

    @property
    def size(self) -> int:
        return 4 if self.of_words else 1

    def symbols(self, data: bytes) -> np.ndarray:
        return words(data) if self.of_words else np.frombuffer(data, dtype=np.uint8)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        if not self.of_words:
            return _TABLE[symbols]
        mixed = symbols.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` values, by doubling."""
    h, k, out, done, power = values, 1, None, 0, _BASE
    while True:
        if width & k:  # the low bits of width come first in the string
            out = h if out is None else out[: len(h) - done] * power + h[done:] if done else h
            done += k
        if 2 * k > width:
            return out[: max(0, len(values) - width + 1)]
        h = h[:-k] * power + h[k:] if len(h) > k else h[:0]
        with np.errstate(over="ignore"):
            power = power * power
        k *= 2


def anchors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts at [starts, ends): text number, first window, anchor, last window (in values), and the anchor's hash."""
    grams = rolling(values, gram)
    key = (grams * np.uint64(0xC2B2AE3D27D4EB4F)) & ~np.uint64(_POSITION) | np.arange(len(grams), dtype=np.uint64)
    span, k = length - gram + 1, 1
    low = key
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
    at = (low & np.uint64(_POSITION)).astype(np.int64)
    long = np.flatnonzero(ends - starts >= length)
    counts = ends[long] - starts[long] - length + 1
    p = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    a = at[p]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:], [len(a)]])[: len(first)] - 1
    return np.repeat(long, counts)[first], p[first], a[first], p[last], grams[a[first]].view(np.int64)


def _blocks(texts: list[np.ndarray], length: int) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray]]]:
    """Pieces of texts to hash together: (text number, offset of the piece) and symbols; pieces of a long text overlap by length - 1."""
    names: list[tuple[int, int]] = []
    pieces: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _BLOCK):
            piece = t[at : at + _BLOCK + length - 1]
            if len(piece) < length:
                continue
            if size and size + len(piece) > _BLOCK:
                yield names, pieces
                names, pieces, size = [], [], 0
            names.append((i, at))
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield names, pieces


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _anchor_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for names, pieces in _blocks([unit.symbols(x) for x in batch.column("data").to_pylist()], unit.length):
                sizes = np.array([len(x) for x in pieces])
                ends, joined = np.cumsum(sizes), np.concatenate(pieces)
                which, lo, a, hi, gram = anchors(unit.values(joined), ends - sizes, ends, unit.length, unit.gram)
                raw, k = joined.tobytes(), unit.size
                digests = [_digest(raw[x:y]) for x, y in zip((lo * k).tolist(), ((hi + unit.length) * k).tolist(), strict=True)]
                shift = np.array([at for _, at in names])[which] - (ends - sizes)[which]
                owner = [keys[i] for i, _ in names]
                columns = [pa.array([owner[w] for w in which.tolist()], pa.binary()), *(pa.array((x + shift).astype(np.int32)) for x in (lo, a, hi)), pa.array(gram), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lo", "a", "hi", "gram", "context"])

    return texts.select("key", "data").mapInArrow(run, "key binary, lo int, a int, hi int, gram long, context binary")


# A suffix in a run: its bytes, the number of symbols from the anchor on, its owner (key, first window), and whether other texts have all its windows.
Suffix = tuple[bytes, int, bytes, int, int]


def common_prefix(s: bytes, t: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    n, i = min(len(s), len(t)), known
    while i < n and s[i : i + 64] == t[i : i + 64]:
        i += 64
    if i >= n:
        return n
    step = 32
    while step:
        if s[i : i + step] == t[i : i + step]:
            i += step
        step //= 2
    return min(i, n)


def front_code(run: list[Suffix]) -> tuple[bytes, bytes, bytes]:
    """A sorted run as numbers (common prefix with the one before, length, symbols from the anchor on, first window, several texts), tails, and keys."""
    numbers, tails, before = np.zeros((len(run), 5), dtype="<i4"), [], b""
    for i, (s, right, _, lo, several) in enumerate(run):
        k = common_prefix(before, s, 0)
        numbers[i] = (k, len(s), right, lo, several)
        tails.append(s[k:])
        before = s
    return numbers.tobytes(), b"".join(tails), b"".join(x[2] for x in run)


def read_run(numbers: bytes, tails: bytes, keys: bytes) -> Iterator[tuple[int, Suffix]]:
    """Each suffix with its common prefix with the one before."""
    before, at = b"", 0
    for i, (k, n, right, lo, several) in enumerate(np.frombuffer(numbers, dtype="<i4").reshape(-1, 5).tolist()):
        s = before[:k] + tails[at : at + n - k]
        at += n - k
        yield k, (s, right, keys[16 * i : 16 * i + 16], lo, several)
        before = s


def merge_runs(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Loser tree over sorted runs; each suffix comes with its common prefix with the one before it in the output."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    players = [next(r, None) for r in runs] + [None] * (size - len(runs))
    losers = [0] * size

    def beats(a: int, b: int) -> bool:
        """Does a come before b? Both know their common prefix with the last winner; the loser gets its common prefix with this one."""
        x, y = players[a], players[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if x[0] != y[0]:
            return x[0] > y[0]
        k = common_prefix(x[1][0], y[1][0], x[0])
        s, t = x[1][0], y[1][0]
        first = (s[k : k + 1], x[1][1], a) <= (t[k : k + 1], y[1][1], b)
        if first:
            players[b] = (k, y[1])
        else:
            players[a] = (k, x[1])
        return first

    winners = list(range(size, 2 * size))
    tree = [0] * size + [i - size for i in winners]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i], losers[i] = (a, b) if beats(a, b) else (b, a)
    best = tree[1]
    while players[best] is not None:
        yield players[best]
        players[best] = next(runs[best], None) if best < len(runs) else None
        i = (best + size) // 2
        while i:
            if beats(losers[i], best):
                best, losers[i] = losers[i], best
            i //= 2


def repeated_windows(merged: list[tuple[int, Suffix]], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of merged suffixes repeat: for each suffix and number d, whether the window that begins d symbols before the anchor does; and each suffix's greatest d."""
    n, k = len(merged), unit.size
    right = np.array([s[1] for _, s in merged])
    common = np.array([c for c, _ in merged]) // k
    before = [s[0][s[1] * k :] for _, s in merged]  # the symbols before the anchor, backwards
    left = np.array([len(b) for b in before]) // k
    order = np.array(sorted(range(n), key=before.__getitem__))
    common_left = np.array([0, *(common_prefix(before[i], before[j], 0) // k for i, j in zip(order[:-1], order[1:], strict=True))])
    owner = np.unique([s[2] for _, s in merged], return_inverse=True)[1]
    several = np.array([s[4] for _, s in merged]) > 0
    hit = np.zeros((n, int(left.max()) + 1), dtype=bool)
    beside = np.empty(n, dtype=np.int64)
    for d in range(hit.shape[1]):
        at = np.flatnonzero((left >= d) & (right >= unit.length - d))
        if not len(at):
            continue
        beside[order] = np.cumsum(common_left < d)
        both = (np.cumsum(common < unit.length - d) * (n + 1) + beside)[at]
        at = at[np.argsort(both, kind="stable")]
        both.sort()
        first = np.flatnonzero(np.diff(both, prepend=-1))
        if unit.across:
            found = (np.minimum.reduceat(owner[at], first) < np.maximum.reduceat(owner[at], first)) | np.logical_or.reduceat(several[at], first)
        else:
            found = np.diff(first, append=len(at)) > 1
        hit[at, d] = np.repeat(found, np.diff(first, append=len(at)))
    return hit, left


def _stretches(hit: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return np.stack([edge[::2], edge[1::2] - 1], axis=1)


def heavy_grams(texts: DataFrame, unit: Unit, share: float, fraction: float, least: int = 10) -> list[int]:
    """Grams that have more than a share of the anchors of a sample of the texts: 1 / share at most. They only decide how anchors are dealt out, not what is found."""
    some = materialize(_anchor_rows(texts.sample(fraction, seed=7), unit).groupBy("gram").agg(F.count("*").alias("n")), "sampled-grams")
    total = some.agg(F.sum("n")).first()[0] or 0
    return [r["gram"] for r in some.where(F.col("n") > max(least, share * total)).select("gram").collect()]


@only_result
def find_spans(texts: DataFrame, unit: Unit, hot: int = 10_000, range_bytes: int = 2 << 20, share: float | None = None, fraction: float = 0.02, least: int = 10) -> DataFrame:
    """One row per text (key, data) with repeated windows: key, spans (array of first and last window starts).

    If only other texts count (``unit.across``), each repeated window of a text is in a span at least once. Grams with more than a ``share`` of
    all anchors (twice what a partition holds, unless it is given) are dealt over many tasks; ``fraction`` and ``least`` say how they are found.
    """
    spark = texts.sparkSession
    length, k = unit.length, unit.size
    # One exchange by gram tells which anchors have the same symbols all around (their windows repeat as a whole; the first stands for all
    # in what follows) and how many different ones a gram has. Grams with a large share of all anchors are dealt out, and counted apart.
    share = 2 / int(spark.conf.get("spark.sql.shuffle.partitions")) if share is None else share
    heavy = heavy_grams(texts, unit, share, fraction, least)
    rows = _anchor_rows(texts, unit).withColumn("heavy", F.col("gram").isin(heavy) if heavy else F.lit(False))
    rows = rows.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("key", "lo"), F.lit(1024))).otherwise(0)).repartition("gram", "salt")
    same = Window.partitionBy("gram", "salt", "context")
    alike = F.min("key").over(same) < F.max("key").over(same) if unit.across else F.count("*").over(same) > 1
    rows = rows.withColumn("several", alike).withColumn("first", F.row_number().over(same.orderBy("key", "lo")) == 1)
    rows = rows.withColumn("times", F.sum(F.col("first").cast("int")).over(Window.partitionBy("gram", "salt")))
    found = materialize(rows.where(F.col("heavy") | F.col("several") | (F.col("first") & (F.col("times") > 1))).drop("salt"), "anchors")
    light = found.where(~F.col("heavy"))
    spans = light.where("several").select("key", F.col("lo").alias("first"), F.col("hi").alias("last"))
    columns = ["key", "lo", "a", "hi", "gram", "several", "times"]
    shared = light.where("first and times > 1").select(*columns)
    if heavy:
        dealt = found.where("heavy").select("key", "lo", "a", "hi", "gram", "context")
        one = F.min(F.struct("key", "lo", "a", "hi", "gram")).alias("first")
        several = F.col("first.key") < F.col("n") if unit.across else F.col("n") > 1
        contexts = dealt.groupBy("context").agg(one, (F.max("key") if unit.across else F.count("*")).alias("n"))
        contexts = materialize(contexts.select("context", "first", several.alias("several")), "contexts")
        twins = contexts.where("several").select("context", F.lit(True).alias("twin"))
        spans = spans.union(lookup_join(dealt, twins, "context", F.lit(128), 8 << 20).where("twin").select("key", "lo", "hi"))
        times = contexts.groupBy("first.gram").agg(F.count("*").alias("times"))  # a row for each heavy gram
        shared = shared.union(contexts.select("several", "first.*").join(F.broadcast(times), "gram").where("times > 1").select(*columns))
    shared, spans = materialize(shared, "shared-anchors"), materialize(spans, "twins")
    cold, warm = shared.where(F.col("times") <= hot), shared.where(F.col("times") > hot)
    total, rows_hot = shared.agg(F.sum(F.when(F.col("times") <= hot, F.col("hi") - F.col("lo") + length)), F.count(F.when(F.col("times") > hot, 1))).first()
    ranges = max(1, math.ceil((total or 0) * k / range_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_range: dict[int, list[Suffix]] = {}
            for key, data, found_here in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                text = unit.symbols(data)
                for x in found_here:
                    lo, a, end = x["lo"], x["a"], x["hi"] + length
                    suffix = text[a:end].tobytes() + text[lo:a][::-1].tobytes()
                    by_range.setdefault((x["gram"] % (1 << 64)) * ranges >> 64, []).append((suffix, end - a, key, lo, int(x["several"])))
            out: list[list] = [[], [], [], []]
            for r, run in by_range.items():
                run.sort()
                for column, value in zip(out, (r, *front_code(run)), strict=True):
                    column.append(value)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["range", "numbers", "tails", "keys"])

    def receive(table: pa.Table) -> pa.Table:
        runs = [read_run(*x) for x in zip(table.column("numbers").to_pylist(), table.column("tails").to_pylist(), table.column("keys").to_pylist(), strict=True)]
        merged = list(merge_runs(runs))
        hit, left = repeated_windows(merged, unit)
        keys, firsts, lasts = [], [], []
        for (_, (_, _, key, lo, _)), windows, most in zip(merged, hit, left.tolist(), strict=True):
            for first, last in _stretches(windows[: most + 1][::-1]).tolist():
                keys.append(key)
                firsts.append(lo + first)
                lasts.append(lo + last)
        return pa.table([pa.array(keys, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["key", "first", "last"])

    def held(rows: DataFrame) -> DataFrame:
        """The texts of these anchors, each with its anchors."""
        of_text = rows.groupBy("key").agg(F.collect_list(F.struct("lo", "a", "hi", "gram", "several")).alias("anchors"))
        return texts.select("key", "data").join(of_text, "key")

    runs = held(cold).select("key", "data", "anchors").mapInArrow(send, "range int, numbers binary, tails binary, keys binary")
    spans = spans.union(runs.groupBy("range").applyInArrow(receive, "key binary, first int, last int"))
    if rows_hot:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, data, found_here in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                    text = unit.symbols(data)
                    for x in found_here:
                        raw, at = text[x["lo"] : x["hi"] + length].tobytes(), np.arange(x["lo"], x["hi"] + 1, dtype=np.int32)
                        digests = [_digest(raw[i : i + length * k]) for i in range(0, len(at) * k, k)]
                        columns = [pa.array([key] * len(at), pa.binary()), pa.array(at), pa.array(digests, pa.binary()), pa.array([x["several"]] * len(at))]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "at", "window", "several"])

        rows = materialize(held(warm).mapInArrow(windows, "key binary, at int, window binary, several boolean"), "hot-windows")
        again = rows.groupBy("window").agg(((F.min("key") < F.max("key")) | F.bool_or("several") if unit.across else F.count("*") > 1).alias("again")).where("again")
        hits = lookup_join(rows, again, "window", F.lit(128), 8 << 20).where("again")
        spans = spans.union(hits.select("key", F.col("at").alias("first"), F.col("at").alias("last")))
    return materialize(spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")), "spans")


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (MD5 of the UTF-8 bytes), n (rows that have the text) and data, from a table bucketed by key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("t")).groupBy("key").agg(F.count("*").alias("n"), F.first("t").alias("t"))
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"repeats_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"  # the warehouse may be a folder of each machine
    distinct.write.bucketBy(buckets, "key").option("compression", "zstd").option("path", path).saveAsTable(table)
    note_table(table, path)
    return spark.table(table).select("key", "n", F.encode("t", "utf-8").alias("data"))


def covered(size: int, spans: list[tuple[int, int]], whole: bool, length: int) -> list[tuple[int, int]]:
    """Maximal removed stretches [start, end) of a text from its repeated window starts."""
    if whole and size >= length:
        return [(0, size)]
    out: list[list[int]] = []
    for first, last in spans:
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def shared_words(data: bytes, spans: list[tuple[int, int]], whole: bool, unit: Unit) -> int:
    """Words in windows that other texts have; of equal windows of a text, spans name one at least."""
    if not spans and not whole:
        return 0
    symbols = unit.symbols(data)
    n = max(0, len(symbols) - unit.length + 1)
    if whole or not n:
        return len(symbols) if n else 0
    hash_, hit = rolling(unit.values(symbols), unit.length), np.zeros(n, dtype=bool)
    for first, last in spans:
        hit[first : last + 1] = True
    hit = np.isin(hash_, hash_[hit])
    edges = np.cumsum(np.bincount(np.flatnonzero(hit), minlength=len(symbols) + 1) - np.bincount(np.flatnonzero(hit) + unit.length, minlength=len(symbols) + 1)[: len(symbols) + 1])
    return int((edges > 0).sum())


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, passage: int = 50, **options) -> DataFrame:
    """One row per distinct text: key, n_bytes, removed (array of start and end), kept (binary), shared_words (those in passages of ``passage`` words that other texts have)."""
    by_byte, by_word = Unit(False, length, 48, False), Unit(True, passage, 8, True)
    texts = distinct_texts(docs, text_col)
    spans, passages = find_spans(texts, by_byte, **options), find_spans(texts, by_word, **options).withColumnRenamed("spans", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda spans: [(s["first"], s["last"]) for s in spans or []]
        for batch in batches:
            rows = []
            for data, n, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("data", "n", "spans", "passages")), strict=True):
                gone = covered(len(data), pairs(spans), n > 1, length)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rows.append((len(data), [{"start": a, "end": b} for a, b in gone], b"".join([*kept, data[at:]]), shared_words(data, pairs(passages), n > 1, by_word)))
            types = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "n_bytes", "removed", "kept", "shared_words"])

    found = texts.join(spans, "key", "left").join(passages, "key", "left")
    return found.mapInArrow(run, "key binary, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, shared_words long")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sizes = F.transform("removed", lambda r: r["end"] - r["start"])
    with own_tables() as own:
        done = without_repeats(docs).select(
            "key",
            "n_bytes",
            F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_removed"),
            F.size("removed").cast("long").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256"),
            F.col("shared_words").alias("n_shared_words"),
        )
        done = materialize(done, "digests")
        discard(spark, own[:-1])
    light = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    return light.join(done, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
