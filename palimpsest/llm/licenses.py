"""Licence scans with a positional index of rare licence words.

Words are runs of digits, a-z and everything beyond ASCII, after lower-casing A-Z. The templates' words,
each with its places in the templates, form the index. Document frequencies of all licence words come
from the whole corpus. For each template whose mandatory words a file has, the ``agree`` words of the mandatory phrase
with the highest inverse document frequency are looked up (all of a phrase with fewer), and every posting proposes the place at which
its template would begin (the file's position less the template's). The proposals of the words are intersected; where all
propose the same place, the template is compared there word for word: the mandatory phrase must stand complete, and the share of the
template's words that stand at their places must reach ``coverage``. The score is the best such share. As the mandatory phrase must stand
complete, every place where a template can stand is proposed, whatever else the file holds.

Plain phrases are counted beside that, word for word. Null texts count as empty. Equal texts get equal results;
places are counted from word 0, and ties between templates don't matter since all that match are listed. Columns of the input stay
unless they are named like a new one. DataFrame expressions only: after the counts of the licence words, of a fixed number, each
file is looked at by itself, so that nothing is shuffled. The index has a fixed size, that of the templates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, free_name

NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the plain count and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, text, mandatory phrase (fixed values: wording of the public licences' notices).
TEMPLATES = (
    ("mit", "Released under the MIT License", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License, v. 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORDS), "")


def _cut(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORDS, text.lower()) if w]


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _phrase_places(words: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """array<struct(at, label)>: where phrases stand, by place."""

    def at(i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in phrases:
            stands = reduce(lambda a, b: a & b, (F.get(words, i + j) == w for j, w in enumerate(_cut(phrase))))
            label = F.when(stands, F.lit(name)).otherwise(label)
        return F.struct(i.alias("at"), label.alias("label"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at), lambda p: p["label"].isNotNull())


def scan_licenses(
    df: DataFrame,
    text_col: str = "text",
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    agree: int = 2,
    coverage: float = 0.8,
) -> DataFrame:
    """df with n_words long, phrase_places array<struct(at, label)>, template_labels array<string>, score double."""
    columns = [c for c in df.columns if c not in ("n_words", "phrase_places", "template_labels", "score")]
    cut = [(label, _cut(text), _cut(key)) for label, text, key in templates]
    vocabulary = sorted({w for _, text, _ in cut for w in text})
    # Document frequencies: a row for each licence word, so of a fixed number.
    present = df.select(F.explode_outer(F.array_intersect(words_of(F.col(text_col)), _array(vocabulary))).alias("w"))
    counts = {r[0]: r[1] for r in present.where("w is not null").groupBy("w").count().collect()}
    # A look at the raw text comes first, since few files hold any of these words.
    holds = lambda some: F.coalesce(text_col, F.lit("")).rlike(f"(?i){'|'.join(sorted(some))}")
    words, checked = free_name(df, "_words"), free_name(df, "_checked")
    none = F.array().cast("array<struct<at:int,label:string>>")

    def compared(file: Column, begin: Column, label: str, text: list[str], start: int, end: int) -> Column:
        same = F.transform(_array(text), lambda w, i: F.coalesce(F.get(file, begin + i) == w, F.lit(False)))
        whole = F.forall(F.slice(same, start + 1, end - start), lambda x: x)
        return F.struct(F.lit(label).alias("label"), F.when(whole, F.size(F.filter(same, lambda x: x)) / len(text)).alias("share"))

    def standing(file: Column) -> Column:
        """array<struct(label, share)>: the templates that stand in a file."""
        found = []
        for label, text, key in cut:
            start = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
            # Rarest first: highest inverse document frequency. A place where the template can stand has all its mandatory words, so these among them.
            rare = sorted(set(key), key=lambda w: (counts.get(w, 0), w))[:agree]
            proposals = lambda w: F.transform(
                F.filter(F.transform(file, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()), lambda i: i - (start + key.index(w))  # noqa: B023
            )
            places = reduce(F.array_intersect, map(proposals, rare))
            complete = F.size(F.array_intersect(file, _array(sorted(set(key))))) == len(set(key))
            shares = F.transform(places, lambda b: compared(file, b, label, text, start, start + len(key)))  # noqa: B023
            found.append(F.when(holds({max(key, key=len)}) & complete, shares).otherwise(F.array().cast("array<struct<label:string,share:double>>")))
        return F.filter(F.flatten(F.array(*found)), lambda c: c["share"] >= coverage)

    keys, lasts = {max(key, key=len) for _, _, key in cut}, {_cut(p)[-1] for p, _ in phrases}
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    found = df.select(*columns, *([] if text_col in columns else [text_col]), words_of(F.col(text_col)).alias(words))
    found = found.withColumn(checked, F.when(holds(keys), standing(F.col(words))).otherwise(nothing))
    return found.select(
        *columns,
        F.size(words).cast("long").alias("n_words"),
        F.when(holds(lasts), _phrase_places(F.col(words), phrases)).otherwise(none).alias("phrase_places"),
        F.array_sort(F.array_distinct(F.transform(checked, lambda c: c["label"]))).alias("template_labels"),
        F.coalesce(F.array_max(F.transform(checked, lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    at, base = F.transform("phrase_places", lambda p: p["at"]), F.transform("phrase_places", lambda p: p["label"])
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("phrase_places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "template_labels")), ",").alias("labels"),
        "score",
    )
