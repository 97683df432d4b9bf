"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code points and, by a table, of character classes. The pre-tokeniser is a small
automaton over these classes. A class acts on the automaton's states as a function; the functions that
arise form a finite monoid with a composition table, so the states before every character come from an
associative scan by doubling, which stops once all prefixes are constant functions (after two or three
doublings: no state depends on more than the last few characters). Token starts follow from the state
before a character, its class and the class of the next one; no regular expression runs. The slices
between starts are merged pair by pair, least rank first, through a cache; the token offsets in bytes
are what decoding cuts by.

The pattern followed is that of the rank files: contractions ('s 't 're 've 'm 'll 'd), then letters,
numbers or other signs with one optional space before them, then white space, whose last character is
left for what follows. Null texts count as empty; an empty text has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import free_name

# Character classes.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE, ONE, TWO_R, TWO_L, END = range(10)  # ONE: s t m d; TWO_R: r v (before e); TWO_L: l
E_CLASS = 10
_CLASSES = 11
#: White space of \s apart from the space itself (fixed values of the Unicode property White_Space).
_WHITE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: what the character before was, as far as the next token start depends on it.
(S_START, S_LETTERS, S_NUMBERS, S_OTHERS, S_SPACE, S_BLANK, S_LONE, S_WAIT_E, S_WAIT_L, S_DONE) = range(10)


def _step(state: int, cls: int) -> int:
    """S_LONE: an apostrophe that starts a match; S_WAIT_E, S_WAIT_L: after it r or v, or l; S_DONE: a contraction ended."""
    if cls == END:
        return S_START
    if cls in (SPACE, BLANK):
        return S_SPACE if cls == SPACE else S_BLANK
    if cls == NUMBER:
        return S_NUMBERS
    if cls == OTHER:
        return S_OTHERS
    if cls == APOSTROPHE:
        return S_OTHERS if state in (S_OTHERS, S_SPACE, S_LONE) else S_LONE
    if state == S_LONE:
        return {ONE: S_DONE, TWO_R: S_WAIT_E, TWO_L: S_WAIT_L}.get(cls, S_LETTERS)
    if state == S_WAIT_E and cls == E_CLASS or state == S_WAIT_L and cls == TWO_L:
        return S_DONE
    return S_LETTERS


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class its function, the composition table (first, then second), and each function's value at S_START."""
    functions = [tuple(_step(s, c) for s in range(10)) for c in range(_CLASSES)]
    known = {f: i for i, f in enumerate(dict.fromkeys(functions))}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
    names = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in names] for f in names], dtype=np.uint8)
    return np.array([known[f] for f in functions], dtype=np.uint8), table, np.array([f[S_START] for f in names], dtype=np.uint8)


@lru_cache(1)
def _class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    table[_WHITE] = BLANK
    for chars, k in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", ONE), ("rv", TWO_R), ("l", TWO_L), ("e", E_CLASS)):
        table[[ord(c) for c in chars]] = k
    return table


_LETTERS = (LETTER, ONE, TWO_R, TWO_L, E_CLASS)
_SIGNS = (OTHER, APOSTROPHE)


def _starts(state: int, cls: int) -> bool:
    """Does a pre-token start at a character of this class, as far as what lies before it tells?"""
    if cls == END:
        return True
    if cls in (SPACE, BLANK):
        return state not in (S_SPACE, S_BLANK)
    if state == S_SPACE:
        return False
    if cls in _LETTERS:
        return state not in (S_LETTERS, S_WAIT_E, S_WAIT_L)
    if cls == NUMBER:
        return state != S_NUMBERS
    return state not in (S_OTHERS, S_LONE)


_STARTS = np.array([[_starts(s, c) for c in range(_CLASSES)] for s in range(10)]).ravel()
_LONE = np.array([[c == APOSTROPHE and _step(s, c) == S_LONE for c in range(_CLASSES)] for s in range(10)]).ravel()
_WHITES = np.isin(np.arange(_CLASSES), [SPACE, BLANK])
_IS_LETTER = np.isin(np.arange(_CLASSES), _LETTERS)


def token_starts(points: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Indexes at which a pre-token starts, in the code points of a text, or of texts each followed by one point that ``ends`` names."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = _class_table()[points]
    if ends is not None:
        cls[ends] = END
    of_class, table, at_start = _monoid()
    size, flat, step = len(table), table.ravel(), 1
    constant = (table == np.arange(size)[None, :]).all(axis=0)  # what comes before such a function doesn't matter
    scan = of_class[cls]
    while step < n and not constant[scan[step:]].all():
        scan[step:] = flat[scan[:-step].astype(np.uint16) * size + scan[step:]]
        step *= 2
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = S_START, at_start[scan[:-1]]
    both = before * np.uint8(_CLASSES) + cls
    start = _STARTS[both]
    # White space followed by something else leaves its last character to it, or alone; at the end of a text it stays whole.
    white = _WHITES[cls]
    start[:-1] |= white[:-1] & ~white[1:] & (cls[1:] != END)
    lone = np.flatnonzero(_LONE[both])  # contractions: an apostrophe that starts a match, before s t m d, or re ve ll
    if len(lone):
        pad = np.concatenate([cls, [END, END, END]])
        one = pad[lone + 1] == ONE
        two = (pad[lone + 1] == TWO_R) & (pad[lone + 2] == E_CLASS) | (pad[lone + 1] == TWO_L) & (pad[lone + 2] == TWO_L)
        for at in (lone[one] + 1, lone[two] + 1, lone[two] + 2):
            start[at] = False
        after = np.concatenate([lone[one] + 2, lone[two] + 3])
        after = after[_IS_LETTER[pad[after]]]
        start[after] = True
    return np.flatnonzero(start)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks) + 1
    pairs = [get(a + b, none) for a, b in pairwise(parts)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return tuple(map(ranks.__getitem__, parts))


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the adjacent pair of least rank is merged first, the leftmost of equals; a heap keeps long pieces cheap."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n < 64:
        return _merge_short(piece, ranks)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        j = end[i]
        alive[j] = False
        end[i] = to
        if to < n:
            left[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
            heapq.heappush(heap, (r, k, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Encoder:
    """Ranks with a bounded cache of merged pre-tokens; when full, the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 300_000):
        self.ranks, self.cache, self.cache_size = ranks, {}, cache_size
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocabulary[i] = token
        self.lengths = np.array([len(t) for t in self.vocabulary], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str], block: int = 1 << 18) -> Iterator[np.ndarray]:
        """The ids of each text; short texts are cut into pre-tokens many at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < block):
                size += len(texts[j]) + 1
                j += 1
            joined = "\0".join(texts[i:j]) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
            cuts = token_starts(points, ends)
            first = np.searchsorted(cuts, ends).tolist()
            cuts, at = cuts.tolist(), 0
            for k in first:
                yield self._merge_all(joined, cuts[at : k + 1])
                at = k + 1
            i = j

    def _merge_all(self, text: str, cuts: list[int]) -> np.ndarray:
        ids: list[int] = []
        cache, add = self.cache, ids.extend
        for a, b in pairwise(cuts):
            piece = text[a:b]
            found = cache.get(piece)
            if found is None:
                if len(cache) >= self.cache_size:
                    cache.clear()
                found = cache[piece] = merge_pairs(piece.encode("utf-8", "surrogatepass"), self.ranks)
            add(found)
        return np.array(ids, dtype="<u4")

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each id's bytes end."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: A worker's encoder and the digest of its ranks: kept from task to task, so that its cache stays warm.
_own: dict[str, Encoder] = {}


def _encoder(digest: str, ranks) -> Encoder:
    if digest not in _own:
        _own.clear()
        _own[digest] = Encoder(ranks.value)
    return _own[digest]


def _with_ids(df: DataFrame, text_col: str, ranks_path: str | None, added: list[T.StructField], of_ids) -> DataFrame:
    """df and the added columns, which of_ids(encoder, ids) gives. The driver reads the ranks, a table of fixed size, and sends them to the executors."""
    ranks = read_ranks(ranks_path or default_ranks_path())
    names = [f.name for f in added]
    df = df.drop(*names)
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    digest = hashlib.sha256(b"".join(sorted(ranks))).hexdigest()
    hidden, schema = free_name(df, "_whole"), T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(digest, sent)
        for batch in batches:
            texts = [t or "" for t in batch.column(hidden).to_pylist()]
            rows = [of_ids(encoder, ids) for ids in encoder.encode_all(texts)]
            kept = batch.drop_columns([hidden])
            new = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(_arrow(added))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept.schema.names, *names])

    return df.withColumn(hidden, F.col(text_col)).mapInArrow(run, schema)


def _arrow(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """df with ids (array<int>) and ends (array<long>: the byte offset at which each id's bytes end)."""

    def of_ids(encoder: Encoder, ids: np.ndarray) -> tuple:
        return ids.astype(np.int32), encoder.ends(ids)

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    return _with_ids(df, text_col, ranks_path, added, of_ids)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "bytes", ranks_path: str | None = None) -> DataFrame:
    """df with the decoded bytes of each row's ids; null ids give null."""
    ranks = read_ranks(ranks_path or default_ranks_path())
    df = df.drop(out)
    sent = df.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (x.as_py() for x in batch.column(ids_col))
            made = [None if x is None else b"".join(map(sent.value.__getitem__, x)) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """df with n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256, without moving the ids themselves."""

    def of_ids(encoder: Encoder, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with_ids(df, text_col, ranks_path, added, of_ids)


def encode_with_digests(df: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """df with ids (array<int>), n_tokens, ids_sha256 and decoded_sha256."""

    def of_ids(encoder: Encoder, ids: np.ndarray) -> tuple:
        return ids.astype(np.int32), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with_ids(df.select(*(c for c in df.columns if c != text_col), text_col), text_col, ranks_path, added, of_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
