"""Licence scan by a positional index of rare words, in DataFrame functions only.

The templates' words form a small vocabulary. One pass counts in how many documents each of its words occurs; that gives every word's
inverse document frequency. The index has postings (template, position) for each template's words of the highest IDF, as many as weigh
more than the share of a template that may differ, so at least one of them stands in its place wherever the template counts. A file's
licence words of the highest IDF are those of its words that have postings; each of their places, less a posting's position, is a start
of that template, so the postings are intersected by relative position. At each start all of the template's words are compared place by
place, weighed by their IDF, and a start counts if the weight is at least `least` of the template's and its mandatory phrase is there,
word for word. The base phrases are templates that have to be there as a whole. The words of a file are walked once, for all templates,
and only where one of them has postings.

Defined cases: a null or empty text has no words, no places and no labels; n_words is 0 then. Repeated rows give repeated results.
Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Fixed: the word pattern's complement (Java and RE2 read it alike), the base phrases and their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice, mandatory phrase. Our wording of what projects usually put into their files.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "gnu lesser general public license version", "lesser general public license"),
    ("agpl", "gnu affero general public license version", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "released under the bsd 3 clause license", "bsd 3 clause"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
LEAST = 0.8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def vocabulary(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[str]:
    return sorted({w for _, notice, phrase in templates for w in f"{notice} {phrase}".split()})


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents and, of each of the given words, that of documents that hold it."""
    got = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, words))), F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # a row a word at most
    n = {r["w"]: r["n"] for r in got}
    return n.pop("", 0), n


def anchors(parts: list[str], idf: dict[str, float], least: float) -> list[int]:
    """Positions of the words of the highest IDF, together more than what may differ."""
    spare, out = (1 - least) * sum(idf[w] for w in parts), []
    for k in sorted(range(len(parts)), key=lambda k: (-idf[parts[k]], k)):
        out.append(k)
        spare -= idf[parts[k]]
        if spare < -1e-9:
            break
    return out


def found(words: Column, patterns: list[tuple[str, str, float]], idf: dict[str, float]) -> Column:
    """k (number of the pattern), start and share of IDF that agrees, of every start that counts; patterns: words, mandatory phrase, least share."""
    postings: dict[str, list[tuple[int, int]]] = {}
    rows = []
    for k, (notice, phrase, least) in enumerate(patterns):
        parts = notice.split()
        for at in anchors(parts, idf, least):
            postings.setdefault(parts[at], []).append((k, at))
        begin = len(notice[: f" {notice} ".find(f" {phrase} ")].split())
        strings, doubles = lambda x: F.array(*map(F.lit, x)), lambda x: F.array(*[F.lit(float(y)) for y in x])
        rows.append(F.struct(strings(parts).alias("words"), doubles(idf[w] for w in parts).alias("idf"), F.lit(float(sum(idf[w] for w in parts))).alias("total"), F.lit(begin).alias("begin"), strings(phrase.split()).alias("phrase"), F.lit(float(least)).alias("least")))
    table, known = F.array(*rows), F.array(*map(F.lit, sorted(postings)))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at")) for k, at in postings[w]]))])
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(*sorted(postings)))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda s: F.transform(F.element_at(index, s["w"]), lambda p: F.struct(p["k"].alias("k"), (s["i"] - p["at"]).alias("start"))))))
    # get() is null beyond either end
    there = lambda x, p: F.forall(F.sequence(F.lit(0), F.size(p["phrase"]) - 1), lambda j: F.coalesce(F.get(words, x["start"] + p["begin"] + j) == F.get(p["phrase"], j), F.lit(False)))
    weight = lambda x, p: F.aggregate(F.sequence(F.lit(0), F.size(p["words"]) - 1), F.lit(0.0), lambda sum_, j: sum_ + F.when(F.get(words, x["start"] + j) == F.get(p["words"], j), F.get(p["idf"], j)).otherwise(0.0))
    of = lambda x: F.get(table, x["k"])
    scored = F.transform(F.filter(starts, lambda x: there(x, of(x))), lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), (weight(x, of(x)) / of(x)["total"]).alias("share")))
    none = F.array().cast("array<struct<k:int,start:int,share:double>>")
    return F.when(F.arrays_overlap(words, known), F.filter(scored, lambda x: x["share"] >= of(x)["least"])).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE, least: float = LEAST) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score (the best template's; 1 for a base place)."""
    words = sorted({*vocabulary(templates), *(w for p in base for w in p.split())})
    n, df = document_frequency(docs, words)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in words}
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    # a base phrase's words all have to be there, so its rarest word will do for a posting
    patterns = [*((p, p, 1.0) for p in base), *((notice, phrase, least) for _, notice, phrase in templates)]
    rows = docs.drop(*names).withColumn("_w", words_of(F.col("text")))
    rows = rows.withColumn("_f", found(F.col("_w"), patterns, idf))
    own = F.transform(F.filter("_f", lambda x: x["k"] < len(base)), lambda x: x["start"])
    label_of = F.array(*map(F.lit, [*base.values(), *(t[0] for t in templates)]))
    labels = lambda among: F.array_join(F.sort_array(F.array_distinct(F.transform(among, lambda x: F.get(label_of, x["k"])))), ",")
    best = F.coalesce(F.array_max(F.transform("_f", lambda x: x["share"])), F.lit(0.0))
    return rows.withColumns({
        "n_words": F.size("_w").cast("long"), "n_base": F.size(own).cast("long"), "first_word": F.array_min(own).cast("long"), "last_word": F.array_max(own).cast("long"),
        "base_labels": labels(F.filter("_f", lambda x: x["k"] < len(base))), "labels": labels(F.col("_f")), "score": F.when(F.size(own) > 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), best), 6)),
    }).drop("_w", "_f")


def op6(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE, least: float = LEAST) -> str:
    """The same in DuckDB's SQL: all starts of each mandatory phrase, without an index."""
    at = lambda phrase, shift=0: " AND ".join(f"w[i + {k + shift}] = '{x}'" for k, x in enumerate(phrase.split()))
    found = lambda phrase, value, shift=0: f"CASE WHEN {' AND '.join(f'contains(low, {chr(39)}{x}{chr(39)})' for x in phrase.split())} THEN {value} END"
    vocabulary_ = ", ".join(f"ln((count(*) + 1) / (count(*) FILTER (WHERE list_contains(w, '{x}')) + 0.5)) AS i_{x}" for x in vocabulary(templates))
    bases = ", ".join(f"coalesce({found(p, f'list_filter(range(1, len(w) + 1), lambda i: {at(p)})')}, []) AS b{k}" for k, p in enumerate(base))
    scores = []
    for k, (_, notice, phrase) in enumerate(templates):
        begin = len(notice[: f" {notice} ".find(f" {phrase} ")].split())
        weight = " + ".join(f"CASE WHEN i + {j} >= 1 AND w[i + {j}] = '{x}' THEN i_{x} ELSE 0 END" for j, x in enumerate(notice.split()))
        total = " + ".join(f"i_{x}" for x in notice.split())
        starts = f"list_filter(range(1 - {begin}, len(w) + 1), lambda i: i + {begin} >= 1 AND {at(phrase, begin)})"
        scores.append(f"{found(phrase, f'list_max(list_transform({starts}, lambda i: ({weight}) / ({total})))')} AS t{k}")
    labels = ", ".join([f"CASE WHEN len(b{k}) > 0 THEN '{x}' END" for k, x in enumerate(base.values())] + [f"CASE WHEN t{k} >= {least} THEN '{t[0]}' END" for k, t in enumerate(templates)])
    base_labels = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{x}' END" for k, x in enumerate(base.values()))
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda l: l IS NOT NULL))), ',')"
    best = ", ".join(f"CASE WHEN t{k} >= {least} THEN t{k} ELSE 0 END" for k in range(len(templates)))
    every = " || ".join(f"b{k}" for k in range(len(base)))
    return rf"""
WITH d AS (SELECT doc_id, low, list_filter(regexp_split_to_array(low, '{NO_WORD}'), lambda x: x <> '') AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
f AS (SELECT {vocabulary_} FROM d),
s AS (SELECT doc_id, len(w) AS n_words, {bases}, {", ".join(scores)} FROM d, f),
a AS (SELECT *, {every} AS starts FROM s)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word, {joined(base_labels)} AS base_labels, {joined(labels)} AS labels,
CASE WHEN len(starts) > 0 THEN 1.0 ELSE round(least(1.0, greatest({best})), 6) END AS score FROM a"""
