"""Secret scans: pattern rules and a randomness test battery with length-aware false-discovery control.

Rules (leftmost, non-overlapping for each kind; matches that are too short are dropped afterwards):
``assign`` (a credential word, ``:`` or ``=``, a value of 12 or more), ``access`` (``AKIA`` keys of 18
or more) and ``hex`` (16 or more). The span of an ``assign`` is the whole match.

The battery tests every run of ``[A-Za-z0-9+/_-]``, inside the rules' spans and outside: those of 16 or more with a
letter and a digit, and those of 20 or more with a small letter before a capital. The encoding is the smallest
alphabet that holds the token (hex, base 32, base 36, alphanumeric, base 64). Four tests ask whether its symbols could be
drawn at random: chi-squared for the alphabet's uniformity, the number of runs above and below the alphabet's
middle, the number of runs of capitals, small letters, digits and signs (only too few count: words stay in one class, and
that shows names which are too short for the other tests), and the correlation of successive symbols. The least of the four p-values, times four, is the token's.
Among the tokens of a length band, over all documents, a Benjamini-Hochberg step at level ``fdr`` settles
which are structured: of those thrown out, no more than that share is expected to be random. Bands, so that short tokens, on
which the tests have little power, don't set the threshold for long ones. What isn't thrown out is a ``random``
span, so the level bounds the random tokens that are lost, and the tests' power decides how many structured ones stay.
p-values are counted on a fixed grid, rounded up, so that the step needs one small table of counts.

Null texts count as empty, positions are code points (end exclusive), repeated rows are scanned alike,
and columns of the input stay unless they are named like a new one. DataFrame expressions only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{16,}"
#: Where the battery has candidates: letter and digit, or 20 and more with a small letter before a capital.
MIXED, LONG_MIXED, LONG = "[A-Za-z][^A-Za-z0-9]*[0-9]|[0-9][^A-Za-z0-9]*[A-Za-z]", "[a-z][^A-Za-z]*[A-Z]", 20
#: Upper ends of the length bands, exclusive.
BANDS = (28, 40, 56, 80, 128, 256)
#: Grid of -log10 p: steps and the last one.
_STEP, _LAST = 0.05, 800

_SPAN = "array<struct<start:int,end:int,kind:int,token:string>>"
#: Matches that are walked together: appending to an array copies it, so a text's matches are cut into blocks.
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places: what lies between them is measured, too."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda h, g: F.struct(F.char_length(g).alias("gap"), h.alias("hit"), F.char_length(h).alias("n")))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x["gap"] + x["n"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("token"))
        return F.struct((start + x["n"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    def walk(blocks: Column) -> Column:
        sizes = F.transform(blocks, size)
        begin = lambda sums, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda s, x: s + x)
        each = lambda sums: F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(begin(sums, i).alias("at"), none.alias("out")), step)["out"])
        return F.flatten(_let(sizes, each))

    def cut(xs: Column) -> Column:
        """The matches (the piece after the last match has none) in blocks."""
        n = F.size(F.filter(xs, lambda x: x["hit"].isNotNull()))
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.least(F.lit(_BLOCK), n - b * _BLOCK)))

    return F.when(text.rlike(pattern), _let(_let(pairs, cut), walk)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a normal variable; relative error about 1e-7 on the right (Abramowitz and Stegun 7.1.26 within, Mills' ratio beyond)."""

    def tail(x: Column) -> Column:
        a, t, e = x["a"], x["t"], F.exp(-x["a"] * x["a"])
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        far = e / (a * math.sqrt(math.pi)) * (1 - 1 / (2 * a * a))
        return _let(0.5 * F.when(a < 2.5, poly * e).otherwise(far), lambda p: F.when(x["z"] >= 0, p).otherwise(1 - p))

    scaled = lambda v: F.struct(v.alias("z"), (F.abs(v) / math.sqrt(2)).alias("a"), (1 / (1 + 0.3275911 / math.sqrt(2) * F.abs(v))).alias("t"))
    return _let(_let(z, scaled), tail)


_HEX, _B32, _B36 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


_CLASSES = (string.ascii_uppercase, string.ascii_lowercase, string.digits, "+/")


def _class_share(size: Column, power: int) -> Column:
    """The chance that ``power`` random symbols of the alphabet with that many are of one class."""
    share = lambda a: sum((sum(c in k for c in a) / len(a)) ** power for k in _CLASSES)
    return F.element_at(F.create_map(*(F.lit(v) for a in (_HEX, _B32, _B36, _ALNUM, _ALNUM + "+/") for v in (len(a), share(a)))), size)


def _p_class_runs(plain: Column, size: Column) -> Column:
    """P(at most as many runs of classes as there are): neighbours of one class are counted, with their variance under random symbols."""
    of_class = F.translate(plain, "".join(_CLASSES), "".join(k[0] * len(k) for k in _CLASSES))

    def tail(x: Column) -> Column:
        n, two = x["n"], x["two"]
        variance = (n - 1) * two * (1 - two) + 2 * (n - 2) * (x["three"] - two * two)
        return _upper_tail((n - x["runs"] - (n - 1) * two - 0.5) / F.sqrt(variance))

    runs = F.char_length(F.regexp_replace(of_class, r"(.)\1+", "$1"))
    return _let(F.struct(F.char_length(plain).alias("n"), runs.alias("runs"), _class_share(size, 2).alias("two"), _class_share(size, 3).alias("three")), tail)


def randomness_p(token: Column) -> Column:
    """Combined p-value of the four tests under the token's inferred encoding."""
    is_hex = token.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    symbols = F.when(is_hex, F.lit(_HEX)).when(token.rlike("^[A-Z2-7]+$"), F.lit(_B32)).when(token.rlike("^[a-z0-9]+$"), F.lit(_B36)).when(token.rlike("^[A-Za-z0-9]+$"), F.lit(_ALNUM)).otherwise(F.lit(_ALNUM + "+/"))
    plain = F.when(is_hex, F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    total = lambda xs, zero: F.aggregate(xs, F.lit(zero), lambda s, v: s + v)
    successive = lambda xs, n, f: F.zip_with(F.slice(xs, F.lit(1), n - 1), F.slice(xs, F.lit(2), n - 1), f)

    def uniform(x: Column) -> Column:
        """Chi-squared over the alphabet (Wilson and Hilferty's cube root)."""
        chars, size, n = F.split(x["plain"], ""), F.char_length(x["symbols"]), F.char_length(x["plain"])
        squares = total(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.char_length(F.replace(x["plain"], c, F.lit(""))), F.lit(2))), 0.0)
        chi, df = size / n * squares - n, size - 1
        p = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        at = F.transform(chars, lambda c: F.instr(x["symbols"], c) - 1)
        return F.struct(at.alias("at"), F.transform(at, lambda v: (v * 2 >= size).cast("int")).alias("high"), n.alias("n"), p.alias("p"), _p_class_runs(x["plain"], size).alias("classes"))

    def sums(y: Column) -> Column:
        n, high = y["n"], y["high"]
        runs = 1 + total(successive(high, n, lambda a, b: (a != b).cast("int")), 0)
        off = _let(total(y["at"], 0) / n, lambda centre: F.transform(y["at"], lambda v: v - centre))
        serial = lambda d: F.struct(total(F.transform(d, lambda v: v * v), 0.0).alias("own"), total(successive(d, n, lambda a, b: a * b), 0.0).alias("lagged"))
        return F.struct(n.alias("n"), F.least(y["p"], y["classes"]).alias("p"), total(high, 0).alias("ones"), runs.alias("runs"), _let(off, serial).alias("s"))

    def combined(y: Column) -> Column:
        n, ones = y["n"], y["ones"]
        mean = 2 * ones * (n - ones) / n + 1
        z = lambda m: F.abs(y["runs"] - m) / F.sqrt((m - 1) * (m - 2) / (n - 1))
        p_runs = F.when((ones > 0) & (ones < n), 2 * _upper_tail(_let(mean, z))).otherwise(F.pow(F.lit(0.5), n - 1))
        p_serial = F.when(y["s"]["own"] > 0, 2 * _upper_tail(F.abs(y["s"]["lagged"] / y["s"]["own"] * F.sqrt(n)))).otherwise(0.0)
        return F.least(F.lit(1.0), 4 * F.least(y["p"], F.coalesce(p_runs, F.lit(1.0)), p_serial))

    return _let(_let(_let(F.struct(plain.alias("plain"), symbols.alias("symbols")), uniform), sums), combined)


def _band(length: Column) -> Column:
    return sum(((length >= b).cast("int") for b in BANDS), F.lit(0))


def _base(text: Column) -> Column:
    """The rules' spans."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 12)
    return F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _tokens(text: Column) -> Column:
    """The battery's tokens: span, length band, grid cell of p."""
    mixed = F.filter(_spans(text, TOKEN, 3), lambda s: s["token"].rlike(MIXED) | ((F.char_length(s["token"]) >= LONG) & s["token"].rlike(LONG_MIXED)))
    cell = lambda t: F.least(F.lit(_LAST), F.floor(-F.log10(F.greatest(randomness_p(t), F.lit(1e-300))) / _STEP)).cast("int")
    return F.transform(
        mixed,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), _band(F.char_length(s["token"])).alias("band"), cell(s["token"]).alias("cell")),
    )


def structured_from(df: DataFrame, text_col: str = "text", fdr: float = 0.05) -> dict[int, int]:
    """For each length band the grid cell from which on tokens are structured; a count for each (band, cell) reaches the driver."""
    # The outer form of explode: a filter on the array would be pushed below it and scan every text twice.
    tokens = df.select(F.explode_outer(_tokens(F.coalesce(text_col, F.lit("")))).alias("t")).where("t is not null")
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("t.band", "t.cell").count().collect():
        counts.setdefault(r["band"], {})[r["cell"]] = r["count"]
    out = {}
    for band, by_cell in counts.items():
        total, seen = sum(by_cell.values()), 0
        for cell in sorted(by_cell, reverse=True):  # least p first
            seen += by_cell[cell]
            if 10 ** (-cell * _STEP) <= fdr * seen / total:
                out[band] = cell
    return out


def _scanned(df: DataFrame, text_col: str, fdr: float, thresholds: dict[int, int] | None) -> tuple[DataFrame, str, str, str]:
    """df with the rules' spans, all spans, and the number of tokens tested, and the names of these columns."""
    thresholds = structured_from(df, text_col, fdr) if thresholds is None else thresholds
    limit = F.array(*(F.lit(thresholds.get(b, _LAST + 1)) for b in range(len(BANDS) + 1)))
    names = F.array(*map(F.lit, KINDS))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    named = lambda spans: F.transform(
        F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"))
    )
    base, tokens, every, tested = (free_name(df, n) for n in ("_base", "_tokens", "_every", "_tested"))
    text = F.coalesce(text_col, F.lit(""))
    df = df.withColumn(base, plain(_base(text))).withColumn(tokens, _tokens(text))
    random = F.filter(tokens, lambda s: s["cell"] < F.element_at(limit, s["band"] + 1))
    df = df.withColumn(every, named(F.concat(base, plain(random)))).withColumn(tested, F.size(tokens)).withColumn(base, named(F.col(base)))
    return df.drop(tokens), base, every, tested


def scan_secrets(df: DataFrame, text_col: str = "text", fdr: float = 0.05, thresholds: dict[int, int] | None = None) -> DataFrame:
    """df with base_spans and spans: arrays of struct(start, end, kind) by start, then kind as listed; n_tested: tokens that the battery tested."""
    df = df.drop(*(c for c in ("base_spans", "spans", "n_tested") if c != text_col))
    found, base, every, tested = _scanned(df, text_col, fdr, thresholds)
    return found.select(*df.columns, F.col(base).alias("base_spans"), F.col(every).alias("spans"), F.col(tested).alias("n_tested"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]", fdr: float = 0.05) -> DataFrame:
    """df with every span of the text replaced by the mask; overlapping spans are one. Null texts stay null."""
    found, _, every, _ = _scanned(df, text_col, fdr, None)
    text = F.col(text_col)
    # Where spans begin anew, and where each such stretch ends: spans come by start, so a running maximum of the ends tells.
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.array_append(acc["out"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))).otherwise(acc["out"]).alias("out"),
    )
    clean = _let(F.aggregate(every, init, step), lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size(every) > 0, clean).otherwise(text)).select(*df.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        kind("assign").alias("n_assign"),
        kind("access").alias("n_access"),
        kind("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.col("n_tested").cast("long").alias("n_tested"),
        F.size(F.filter("spans", lambda s: s["kind"] == "random")).cast("long").alias("n_random"),
    )
