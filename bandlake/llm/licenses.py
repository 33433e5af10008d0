"""Licence scans by a positional rare-token index. Only DataFrame functions run here.

A template is a licence notice with a mandatory key phrase. Its postings in the index are the two words of highest IDF of that
phrase, with document frequencies counted over all documents. Each place of such a word in a file proposes (template,
start) by relative position, and the proposals of a template's two words are intersected; what is left holds where the whole key
phrase stands at its place and at most ``allowed`` of the template's other words differ. All steps work on a row's own words, so
that nothing is shuffled but the counts of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of ASCII letters and digits and of all other than ASCII characters.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases: a file holds the label wherever all the words stand one after another.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed texts of public licence notices, the method's own templates: label, mandatory key phrase, percent of the words that may differ, text.
MORE = (
    ("mit", "hereby granted free of charge", 25, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "mit license", 20, "released under the mit license"),
    ("mit", "without restriction including without limitation the rights", 15, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "shall be included in all copies", 15, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "apache license version", 25, "licensed under the apache license version 2 0"),
    ("apache-2", "in compliance with the license", 15, "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "distributed under the license is distributed on an as is basis", 15, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc", "cc by nc", 28, "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", 0, "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international", 10, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike", 0, "creative commons attribution sharealike"),
    ("cc0", "creative commons zero", 0, "creative commons zero"),
    ("bsd", "use in source and", 21, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain", 15, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", 15, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "endorse or promote products derived from this software", 20, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software", 10, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "must not be misrepresented", 15, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "boost software license version 1 0", 20, "distributed under the boost software license version 1 0"),
    ("unlicense", "released into the public domain", 20, "this is free and unencumbered software released into the public domain"),
    ("gpl", "gnu general public license", 0, "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license", 15, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license", 0, "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", 0, "gnu affero general public license"),
    ("mpl-2", "mozilla public license", 20, "mozilla public license version 2"),
    ("mpl-2", "subject to the terms of the mozilla public license", 15, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", 20, "eclipse public license v 2 0"),
    ("all-rights-reserved", "all rights reserved", 0, "all rights reserved"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SPLIT)
    lead, trail = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def templates(base: tuple = BASE, more: tuple = MORE) -> list[tuple]:
    """(label, is_base, words, allowed, first mandatory, last mandatory)."""
    out = [(label, True, p.split(), 0, 0, len(p.split()) - 1) for p, label in base]
    for label, key, percent, text in more:
        phrase, must = text.split(), key.split()
        lo = next(i for i in range(len(phrase)) if phrase[i : i + len(must)] == must)
        out.append((label, False, phrase, len(phrase) * percent // 100, lo, lo + len(must) - 1))
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each vocabulary word stands: at most one row per vocabulary word reaches the driver."""
    seen = docs.select(F.explode(F.array_distinct(F.filter(words(F.col(text_col)), lambda w: w.isin(vocabulary)))).alias("word"))
    return {r[0]: r[1] for r in seen.groupBy("word").count().collect()}


def rare_words(known: list[tuple], counts: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """The index: word to postings (template, place, 0 or 1), for the two rarest words of each key phrase; a phrase of one word has it twice."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, _, phrase, _, lo, hi) in enumerate(known):
        rare = sorted(range(lo, hi + 1), key=lambda i: (counts.get(phrase[i], 0), i))
        for rank, at in enumerate((rare[0], rare[min(1, len(rare) - 1)])):
            index.setdefault(phrase[at], []).append((k, at, rank))
    return index


def licence_hits(docs: DataFrame, base: tuple = BASE, more: tuple = MORE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, hits (array of label, is_base, start, similarity; by start within a label).

    ``start`` is a word's number from 0, ``similarity`` the share of the template's words at their places; a template may end after
    the file's last word as far as its allowance goes. Null and
    empty texts have no words and no hits; repeated rows give repeated results; a phrase standing at several places is
    listed for each; very long texts are searched whole; further columns, whatever their names, are ignored; an empty table gives no rows.
    """
    known = templates(base, more)
    index = rare_words(known, document_frequencies(docs, sorted({w for t in known for w in t[2][t[4] : t[5] + 1]}), text_col))
    lit_words = lambda ws: F.array(*[F.lit(w) for w in ws])
    posting = F.create_map(*[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("i"), F.lit(r).alias("rank")) for k, i, r in ps]))])
    shape = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(b).alias("is_base"), lit_words(p).alias("words"), F.lit(a).alias("allowed"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for label, b, p, a, lo, hi in known])
    held = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    rare_at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(list(index)), i)), lambda i: i.isNotNull())
    proposed = F.flatten(F.transform(rare_at, lambda at: F.transform(F.element_at(posting, F.get("w", at)), lambda p: F.struct(p["rank"].alias("rank"), p["t"].alias("t"), (at - p["i"]).alias("start")))))
    held = held.select("doc_id", "w", proposed.alias("proposed"))
    by_rank = lambda r: F.transform(F.filter("proposed", lambda p: p["rank"] == r), lambda p: F.struct(p["t"].alias("t"), p["start"].alias("start")))
    held = held.select("doc_id", "w", F.when(F.size("proposed") > 1, F.filter(F.array_intersect(by_rank(0), by_rank(1)), lambda p: p["start"] >= 0)).otherwise(F.array().cast("array<struct<t:int,start:int>>")).alias("proposed"))

    def checked(p: Column) -> Column:
        t = F.element_at(shape, p["t"] + 1)
        same = F.transform(t["words"], lambda x, k: F.coalesce(F.get("w", p["start"] + k) == x, F.lit(False)))
        right = F.size(F.filter(same, lambda s: s))
        must = F.forall(F.slice(same, t["lo"] + 1, t["hi"] - t["lo"] + 1), lambda s: s)
        return F.when(must & (F.size(same) - right <= t["allowed"]), F.struct(t["label"].alias("label"), t["is_base"].alias("is_base"), p["start"].alias("start"), (right / F.size(same)).alias("similarity")))

    hits = F.when(F.size("proposed") > 0, F.array_sort(F.filter(F.transform("proposed", checked), lambda h: h.isNotNull())))
    return held.select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce(hits, F.array().cast("array<struct<label:string,is_base:boolean,start:int,similarity:double>>")).alias("hits"))


def licence_summary(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best similarity, 0 without hits)."""
    own = F.filter("hits", lambda h: h["is_base"])
    starts = F.transform(own, lambda h: h["start"].cast("long"))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda h: h["label"]))), ",")
    return hits.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(own).alias("base_labels"), names(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias("score"),
    )


def oracle(base: tuple = BASE, more: tuple = MORE) -> str:
    """DuckDB SQL with the rows of ``licence_summary``."""
    cases, unit = [], []
    for label, is_base, phrase, allowed, lo, hi in templates(base, more):
        at = [f"coalesce(w[i + {k + 1}] = '{x}', false)" for k, x in enumerate(phrase)]
        right = " + ".join(f"CAST({a} AS INT)" for a in at)
        found = f"list_filter(range(len(w)), lambda i: {' AND '.join(at[lo : hi + 1])} AND {len(phrase)} - ({right}) <= {allowed})"
        best = f"list_max(list_transform({found}, lambda i: CAST({right} AS DOUBLE) / {len(phrase)}))"
        cases.append((label, is_base, found))
        unit.append(best)
    base_places = "flatten([" + ", ".join(f for _, b, f in cases if b) + "])"
    names = lambda rows: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len({f}) > 0 THEN '{x}' END" for x, f in rows) + "], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT *, {base_places} AS places FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  {names([(x, f) for x, b, f in cases if b])} AS base_labels, {names([(x, f) for x, _, f in cases])} AS labels,
  coalesce(greatest({", ".join(unit)}), 0.0) AS score
FROM p"""
