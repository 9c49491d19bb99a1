"""License scans (operator 13) by a positional index of rare words, with DataFrame functions only.

Each template is a passage that license notices share, with mandatory phrases in it. Of the phrases' words the rarest in all files (highest inverse document
frequency) are its postings, each with its place in the template. A file is asked for its rare license words; only templates all of whose mandatory words it has
are tried: each place of the rarest word fixes where the template would begin, the other postings must stand at their places from there, then the
phrases are verified word by word, and the share of all the template's words that stand in place is its score. The index words of a template are among
its mandatory ones, so that no placement that would pass is missed, whatever is rare. All of it happens within a row: nothing is shuffled but the counts
of the few license words."""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases of which every place is counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, passage, mandatory phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License", ["may not use this file except in compliance"]),
    ("mit", "released under the MIT License", ["the mit license"]),
    ("mit", "licensed under the terms of the MIT License", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0", ["cc by nc sa"]),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0", ["cc by nc nd"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0 universal"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose", "is hereby granted"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("bsl-1.0", "distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", ["will the authors be held liable"]),
]
#: Postings of a template, and the least share of its words that must stand in place.
POSTINGS, LEAST = 3, 0.6
_TEMPLATE = "array<struct<label string, words array<string>, needed array<string>, keys array<struct<at int, word string>>, postings array<struct<at int, word string>>>>"


def plain_words(text: str) -> list[str]:
    """The words of one of the texts above, as words() gives them for a column."""
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def placed(template: str, phrases: list[str]) -> list[tuple[int, str]]:
    """Place and word of the mandatory phrases in a template, where each stands first."""
    words, out = plain_words(template), {}
    for phrase in map(plain_words, phrases):
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out |= {at + j: w for j, w in enumerate(phrase)}
    return sorted(out.items())


def words(text: str = "text") -> Column:
    """Words of a whole text, A-Z in lower case; none of a null."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def license_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many of all documents each license word stands; a row for each of the vocabulary reaches the driver."""
    found = docs.select(F.explode(F.array_intersect(words(text), strings(vocabulary))).alias("word")).groupBy("word").count()
    return {r.word: r["count"] for r in found.collect()}


def index(counts: dict[str, int], templates: list[tuple[str, str, list[str]]], postings: int = POSTINGS) -> Column:
    """The templates with their postings, the rarest word first, as one constant."""
    rows = []
    for label, template, phrases in templates:
        keys = [{"at": i, "word": w} for i, w in placed(template, phrases)]
        rare = sorted(keys, key=lambda x: (counts.get(x["word"], 0), x["word"], x["at"]))[:postings]
        rows.append({"label": label, "words": plain_words(template), "needed": sorted({x["word"] for x in keys}), "keys": keys, "postings": rare})
    return F.from_json(F.lit(json.dumps(rows)), _TEMPLATE)


def _in_place(found: Column, start: Column, places: Column) -> Column:
    return F.forall(places, lambda x: F.coalesce(F.get(found, start + x["at"]) == x["word"], F.lit(False)))


def _base_place(found: Column, phrases: dict[str, str]) -> Column:
    """Of words with their places: place and label where a phrase begins; null elsewhere."""

    def at(word: Column, i: Column) -> Column:
        out = None
        for phrase, label in phrases.items():
            first, *rest = phrase.split(" ")
            ok = word == first
            for j, w in enumerate(rest, 1):
                ok = ok & (F.get(found, i + j) == w)
            then = F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))
            out = F.when(ok, then) if out is None else out.when(ok, then)
        return out

    return F.filter(F.transform(found, at), lambda x: x.isNotNull())


def _share(found: Column, template: Column) -> Column:
    """The best share of a template's words in place, over all its placements that pass; null without."""
    first = template["postings"][0]
    starts = F.filter(F.transform(found, lambda w, i: F.when(w == first["word"], i - first["at"])), lambda s: s.isNotNull())
    meeting = F.filter(starts, lambda s: _in_place(found, s, template["postings"]))
    verified = F.filter(meeting, lambda s: _in_place(found, s, template["keys"]))
    matched = F.transform(verified, lambda s: F.size(F.filter(F.transform(template["words"], lambda w, i: F.get(found, s + i) == w), lambda x: x)))
    return F.array_max(matched) / F.size(template["words"])


def scanned(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word (of the base phrases), base_labels, labels, score.

    Every place of a base phrase counts. labels: those of base and of templates of which a placement has all phrases and
    at least the share least of its words; score: 1 with a base phrase, else the best such share, else 0. A null or empty
    text has no words, no labels and score 0; rows that repeat an id stand; other columns have no bearing."""
    vocabulary = sorted({w for _, t, p in templates for _, w in placed(t, p)})
    known = strings(sorted({*vocabulary, *(w for p in base for w in p.split(" "))}))
    tried = index(license_counts(docs, vocabulary, text), templates)
    has_base = F.lit(False)
    for phrase in base:
        has_base = has_base | (F.size(F.array_except(strings(phrase.split(" ")), F.col("have"))) == 0)
    rows = docs.select(F.col(key).alias("doc_id"), words(text).alias("words")).withColumn("have", F.array_intersect("words", known))
    rows = rows.withColumns({
        "places": F.when(has_base, _base_place(F.col("words"), base)),
        "tried": F.filter(tried, lambda t: F.size(F.array_except(t["needed"], F.col("have"))) == 0),
    })
    rows = rows.withColumn("found", F.filter(F.transform("tried", lambda t: F.struct(t["label"].alias("label"), _share(F.col("words"), t).alias("share"))), lambda x: x["share"] >= least))
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("places.label"), none)))
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
    )


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def oracle_sql() -> str:
    """The same in DuckDB SQL, by trying each template at each place of its first mandatory word."""
    rows = []
    for n, (label, template, phrases) in enumerate(TEMPLATES):
        keys = placed(template, phrases)
        rows.append(f"({n}, '{label}', {_quoted(plain_words(template))}, {[i for i, _ in keys]}, {_quoted([w for _, w in keys])})")
    base = [f"({_quoted(p.split(' '))}, '{label}')" for p, label in BASE.items()]
    return f"""
        WITH t(n, label, words, ats, keys) AS (VALUES {", ".join(rows)}
        ), b(words, label) AS (VALUES {", ".join(base)}
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
        ), x AS (SELECT r, w, word, i - 1 AS i FROM (SELECT r, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)
        ), p AS (SELECT r, i, label FROM x JOIN b ON x.word = b.words[1] WHERE x.w[i + 1 : i + len(b.words)] = b.words
        ), q AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM p GROUP BY r
        ), c AS (SELECT x.r, x.w, t.*, x.i - t.ats[1] AS s FROM x JOIN t ON x.word = t.keys[1]
        ), f AS (
            SELECT r, label, len(list_filter(range(len(words)), lambda j: s + j >= 0 AND w[s + j + 1] = words[j + 1])) / len(words)::DOUBLE AS share FROM c
            WHERE len(list_filter(range(1, len(keys) + 1), lambda j: s + ats[j] >= 0 AND w[s + ats[j] + 1] = keys[j])) = len(keys)
        ), g AS (SELECT * FROM f WHERE share >= {LEAST}::DOUBLE
        ), h AS (SELECT r, max(share) AS share FROM g GROUP BY r
        ), l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM g) GROUP BY r
        ), m AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM p) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(m.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
        FROM d LEFT JOIN q USING (r) LEFT JOIN h USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)"""
