"""Product-quantised codes of vectors: a codebook for each part position, trained by exact rounds of nearest-entry assignment.

Nearest entries are found by equal-average search. With sums s(x) of d components, |x - e|^2 >= (s(x) - s(e))^2 / d (Cauchy-Schwarz).
Entries are sorted by their sums once; each part starts at its own sum and goes outward, always to the entry with the smaller gap,
until gap^2 / d is strictly more than the best distance: whatever lies beyond is farther. (At equality it goes on, since an equally
near entry with a lower index wins.)

A round is one pass over the vectors: every task adds up its parts by entry and emits a row for each entry it has used, Spark adds
those, and the driver gets the new codebooks: ``entries`` times the vectors' length numbers, whatever the number of rows. All sums
are integers, so neither the order nor a repeated task changes them.

Rows whose vector is null, empty, or has a null or non-finite component are dropped, as are vectors of another length than that of the least key.
Rows without a key are encoded like others, after all others in the order of seeds. Repeated keys are rows of their own (equal keys go by their vectors). Fewer rows
than entries give shorter codebooks; an empty table gives no rows. A length that the parts don't divide, and components whose
distances would overflow 64 bits, raise ValueError.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import lookup_join, materialize
from palimpsest.llm.vectors import as_integers, dimension, is_complete

#: Sums of labels' errors are broadcast up to so many rows.
_BROADCAST_LABELS = 50_000


def nearest(parts: np.ndarray, entries: np.ndarray, together: int = 128, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index. Both are integers, a row each.

    Parts with neighbouring sums go outward together, ``step`` entries at a time, and each leaves a side as soon as its own gap to the next entry there rules that side out.
    """
    n, d = parts.shape
    m, sums = len(entries), entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, own = sums[order], parts.sum(axis=1)
    x, e = parts.astype(np.float64), entries.astype(np.float64)  # products stay below 2^53, so they are exact
    xx, ee = (x * x).sum(axis=1), (e * e).sum(axis=1)
    at, best = np.zeros(n, np.int64), np.full(n, np.inf)
    by_sum = np.argsort(own, kind="stable")
    for first in range(0, n, together):
        rows = by_sum[first : first + together]
        middle = own[rows[len(rows) // 2]]
        low = high = int(np.searchsorted(sums, middle))
        below, above = rows, rows  # the parts for which entries under low, and from high on, are still open
        while True:
            gaps = (own[below] - sums[low - 1] if low else None), (sums[high] - own[above] if high < m else None)
            # A negative gap means that the next entry's sum lies between the part's and the middle: nothing is ruled out.
            below, above = (side[np.maximum(gap, 0) ** 2 <= best[side] * d] if gap is not None else side[:0] for side, gap in zip((below, above), gaps, strict=True))
            if not len(below) and not len(above):
                break
            if len(below) and (not len(above) or middle - sums[low - 1] <= sums[high] - middle):
                own_rows, block, low = below, order[max(0, low - step) : low], max(0, low - step)
            else:
                own_rows, block, high = above, order[high : high + step], min(m, high + step)
            block = np.sort(block)  # of equally near entries the first column is the one with the lowest index
            away = xx[own_rows, None] - 2 * (x[own_rows] @ e[block].T) + ee[block]
            column = away.argmin(axis=1)
            found, index = away[np.arange(len(own_rows)), column], block[column]
            better = (found < best[own_rows]) | ((found == best[own_rows]) & (index < at[own_rows]))
            best[own_rows[better]], at[own_rows[better]] = found[better], index[better]
    return at, best.astype(np.int64)


def _limit(d: int) -> int:
    """So that d squares of differences, and d times that, stay below 2^53."""
    return math.isqrt((1 << 51) // d**2)


def complete_rows(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their vectors' length."""
    kept = df.where(is_complete(F.col(vector)))
    length = dimension(kept, key, vector)
    return kept.where(F.size(vector) == length), length


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[np.ndarray]:
    """The codebooks, one array of integer rows for each part position. Seeds are the parts of the rows with the ``entries`` least keys."""
    kept, length = complete_rows(df, key, vector)
    if length % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {length} components")
    d = length // parts
    seeds = kept.select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).collect()
    if not seeds:
        return [np.zeros((0, d), np.int64) for _ in range(parts)]
    whole = as_integers(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), length, scale, _limit(d))
    books = [whole[:, p * d : (p + 1) * d].copy() for p in range(parts)]
    vectors = kept.select(F.col(vector).cast("array<double>").alias("v"))
    for _ in range(rounds):
        now = books

        def add_up(batches, now=now):
            total, count = [np.zeros_like(b) for b in now], [np.zeros(len(b), np.int64) for b in now]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = as_integers(batch.column(0), length, scale, _limit(d))
                for p, book in enumerate(now):
                    own = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
                    at, _ = nearest(own, book)
                    np.add.at(total[p], at, own)
                    count[p] += np.bincount(at, minlength=len(book))
            used = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in used], pa.int32()),
                    pa.array([int(e) for _, e in used], pa.int32()),
                    pa.array([int(count[p][e]) for p, e in used], pa.int64()),
                    pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "sums"],
            )

        sums = vectors.mapInArrow(add_up, "part int, entry int, n bigint, sums array<bigint>")
        by_place = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = [b.copy() for b in now]
        for r in by_place.collect():  # entries * length rows at most
            books[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return books


def encode(df: DataFrame, books: list[np.ndarray], key: str = "vec_id", vector: str = "embedding", carried: tuple[str, ...] = (), scale: int = 1024) -> DataFrame:
    """(key, carried columns, code, error): the index of each part's nearest entry in two hex digits (more for books of over 256), and the squared distances' sum."""
    kept, length = complete_rows(df, key, vector)
    parts, d, digits = len(books), max(1, length // len(books)), max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    own = kept.select(F.col(vector).cast("array<double>").alias("_v"), *(F.col(c).alias(f"_{i}") for i, c in enumerate((key, *carried))))
    kinds = dict(df.dtypes)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_integers(batch.column(0), length, scale, _limit(d))
            found = [nearest(np.ascontiguousarray(x[:, p * d : (p + 1) * d]), book) for p, book in enumerate(books)]
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack([at for at, _ in found], axis=1).tolist()]
            error = sum(away for _, away in found)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*batch.schema.names[1:], "_code", "_error"])

    assert parts
    shape = ", ".join(f"_{i} {kinds[c]}" for i, c in enumerate((key, *carried)))
    coded = own.mapInArrow(assign, f"{shape}, _code string, _error bigint")
    return coded.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate((key, *carried))), F.col("_code").alias("code"), F.col("_error").alias("error"))


def decode(coded: DataFrame, books: list[np.ndarray], code: str = "code", scale: int = 1024) -> DataFrame:
    """coded with ``vector``: the entries that a code names, divided by the scale."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(int(x) / scale) for x in entry)) for entry in book)) for book in books))
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    one = lambda p: F.conv(F.substring(code, p * digits + 1, digits), 16, 10).cast("int")
    return coded.withColumn("vector", F.concat(*(tables[p][one(p)] for p in range(len(books)))))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings with their errors, and the errors of their labels (rows without a label together)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = train(rows)
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label")
    coded = materialize(encode(rows, books, carried=("label",)).select("vec_id", "code", "error", name), "codes")  # read twice
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    both = lookup_join(coded, sums, "_label", F.lit(1), _BROADCAST_LABELS)
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    """Plain assignments of every part to every entry, ``rounds`` times, over single components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT c.row, c.part, e.entry, sum((c.x - e.x) * (c.x - e.x))::BIGINT AS d FROM cells c JOIN e{k} e USING (part, place) GROUP BY ALL
  ) GROUP BY row, part
)""")
        if k < rounds:
            steps.append(f"""e{k + 1} AS MATERIALIZED (
  SELECT part, entry, place, coalesce(m.x, e.x) AS x FROM e{k} e LEFT JOIN (
    SELECT part, a.entry, place, floor(sum(c.x) / count(*))::BIGINT AS x FROM cells c JOIN a{k} a USING (row, part) GROUP BY ALL
  ) m USING (part, entry, place)
)""")
    joined = ",\n".join(steps)
    return f"""
WITH r AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT row, 4 * i // n AS part, i % (n // 4) AS place, x FROM (SELECT row, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) AS n FROM r)
), e0 AS (
  SELECT part, row - 1 AS entry, place, x FROM cells WHERE row <= 256
), {joined}, coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(coalesce(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place), '')) FROM e{rounds}) AS codebooks_sha256
FROM r JOIN coded USING (row)
"""


SQL = _sql()
