"""Text functions as Column expressions: normal forms, keys, hashes, tokens, derived categories. No Python per row."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of the normalised working-time text, in order of precedence (fixed values).
WORK_MODES = ((("mixta", "hibrid"), "Híbrido"), (("teletrabajo", "remoto", "telepresencial"), "Remoto"), (("terreno",), "Presencial"))
WORK_MODE_UNKNOWN = "No informado"
#: Contract types by what the working-time text contains (fixed values).
CONTRACT_TYPES = (("practica", "Práctica"), ("reemplazo", "Reemplazo"), ("free lance", "Freelance"), ("freelance", "Freelance"), ("comisionista", "Comisionista"))
#: HTML entities that are decoded, in this order (fixed values).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Levels that count as another one, and how names begin that state a level (fixed values).
LEVEL_FOLDS = {"licenciatura": "profesional_con_grado"}
TECHNICAL_NAME = r"^(tecnico|tecnica|tec\b|tns\b|tecnologo)"
HIGHER_NAME = r"^(ingenieria|licenciatura|licenciado|pedagogia|magister|doctorado|mba)\b"
LEVEL_PREFIX = r"^(tecnologo |tecnico en |tecnico |ingenieria civil en |ingenieria civil |ingenieria en |ingenieria |pedagogia en |licenciatura en )"


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, with that letter; combining marks at the end, to be deleted."""
    pairs = {}
    for cp in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(parts) > 1 and len(base) == 1 and base.isascii() and base.islower():
            pairs[chr(cp)] = base
    marks = "".join(chr(c) for c in range(min(sys.maxunicode, 0x36F) + 1) if unicodedata.category(chr(c)) == "Mn")
    return "".join(pairs) + marks, "".join(pairs.values())


def unaccent(s: Column) -> Column:
    """Lower case without marks."""
    source, target = _accents()
    return F.translate(F.lower(s), source, target)


def normalise(s: Column) -> Column:
    """Lower case, no marks, only a-z, 0-9 and single spaces; null gives ''."""
    kept = F.regexp_replace(unaccent(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def fold(s: Column) -> Column:
    """Lower case, no marks, single spaces; punctuation stays; null gives ''."""
    return F.trim(F.regexp_replace(unaccent(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "))


def join_key(s: Column) -> Column:
    """Lower case with single spaces; marks stay. The key of crosswalk joins."""
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def slug(s: Column, separator: str = "_") -> Column:
    """Words of a-z and 0-9 with the separator between; '' if there are none."""
    return F.regexp_replace(F.regexp_replace(unaccent(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", separator), f"^{separator}+|{separator}+$", "")


def slugify(ident: Column, title: Column) -> Column:
    """id-title-words, or null if the title has no usable character."""
    return F.when(slug(title, "-") != "", F.concat(ident.cast("string"), F.lit("-"), slug(title, "-")))


def public_url(prefix: str, given_slug: Column, ident: Column, title: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(given_slug, F.lit("")), slugify(ident, title)))


def strip_html(s: Column) -> Column:
    """Text of an HTML fragment: scripts and styles go, some ends become spaces, other tags vanish, six entities are decoded; empty gives null."""
    t = F.regexp_replace(s, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</li>|</div>", " ")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), F.lit(""))


def content_hash(company: Column, title: Column, description: Column) -> Column:
    """First 16 hex digits of the SHA-1 of company, title and the first 2000 characters of the description."""
    whole = F.concat_ws("|", F.coalesce(company.cast("string"), F.lit("None")), normalise(title), normalise(F.substring(description, 1, 2000)))
    return F.substring(F.sha1(whole.cast("binary")), 1, 16)


def set_hash(items: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the sorted normalised items, repeats kept; null for an empty list."""
    joined = F.array_join(F.array_sort(F.transform(items, normalise)), "|")
    return F.when(F.size(items) > 0, F.substring(F.sha1(joined.cast("binary")), 1, 16))


def _first_that_contains(text: Column, cases) -> Column:
    out = F.lit(None).cast("string")
    for needles, value in reversed(list(cases)):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def work_mode(schedule: Column) -> Column:
    """Where the work is done, as far as the working-time text says; null for an empty text."""
    found = F.coalesce(_first_that_contains(normalise(schedule), WORK_MODES), F.lit(WORK_MODE_UNKNOWN))
    return F.when(F.coalesce(schedule, F.lit("")) != "", found)


def contract_type(schedule: Column) -> Column:
    return F.when(F.coalesce(schedule, F.lit("")) != "", _first_that_contains(normalise(schedule), (((k,), v) for k, v in CONTRACT_TYPES)))


def tokens(s: Column, longer_than: int) -> Column:
    """Distinct normalised words with more than so many letters."""
    return F.array_distinct(F.filter(F.split(normalise(s), " "), lambda w: F.char_length(w) > longer_than))


def all_tokens_match(query: Column, text: Column) -> Column:
    """Does every query token have a text token of which it is a prefix or the other way round? False without query tokens."""
    either = lambda q: F.exists(text, lambda a: F.startswith(a, q) | F.startswith(q, a))
    return (F.size(query) > 0) & F.forall(query, either)


def fold_level(level: Column) -> Column:
    out = F.trim(level)
    for old, new in LEVEL_FOLDS.items():
        out = F.when(F.trim(level) == old, F.lit(new)).otherwise(out)
    return out


def level_list(levels: Column, order: list[str]) -> Column:
    """'a | b' as distinct folded levels in the vocabulary's order, unknown ones last by name."""
    each = F.array_distinct(F.transform(F.filter(F.split(levels, r"\|"), lambda x: F.trim(x) != ""), fold_level))
    vocabulary = F.array(*map(F.lit, order))
    place = lambda x: F.struct(F.when(F.array_position(vocabulary, x) > 0, F.array_position(vocabulary, x)).otherwise(F.lit(1 << 30)).alias("p"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(each, place)), lambda s: s["x"])


def level_shares(text: Column) -> Column:
    """'a 30.8% | b 69.2%' as array<struct(level, share)>; levels that fold together are summed, parts without a number skipped."""
    part = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\|"),
        lambda x: F.struct(
            fold_level(F.regexp_extract(F.trim(x), r"^(.*) ([^ ]*)$", 1)).alias("level"),
            F.regexp_replace(F.regexp_extract(F.trim(x), r"^(.*) ([^ ]*)$", 2), "%+$", "").try_cast("double").alias("share"),
        ),
    )
    good = F.filter(part, lambda p: (p["level"] != "") & p["share"].isNotNull())
    names = F.array_distinct(F.transform(good, lambda p: p["level"]))
    total = lambda n: F.aggregate(F.filter(good, lambda p: p["level"] == n), F.lit(0.0), lambda s, p: s + p["share"])
    return F.transform(names, lambda n: F.struct(n.alias("level"), total(n).alias("share")))


def level_of_name(name: Column) -> Column:
    """The level that a name states at its beginning: tecnico, superior or null."""
    return F.when(fold(name).rlike(TECHNICAL_NAME), "tecnico").when(fold(name).rlike(HIGHER_NAME), "superior")


def core_name(name: Column) -> Column:
    """A program's name without its level prefix."""
    return F.regexp_replace(fold(name), LEVEL_PREFIX, "")


def list_text(items: Column) -> Column:
    return F.array_join(items, " | ")


def text_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
