"""Licence scans with a positional index of rare licence words, with DataFrame functions only.

A template is the wording of a licence notice with the phrases that must stand in it. The
index posts every template under one word of its mandatory phrases, the one with the highest
inverse document frequency in the scanned corpus (fewest documents hold it), with that word's
position. A file's words are looked up in the index: a word at position ``p`` that posts a
template at position ``q`` proposes that the template starts at ``p - q``. The other mandatory
words, rarest first, have to stand at their places relative to that start, which intersects
their postings and verifies the key phrases; the share of all the template's words that stand
in place is the match's share. As the anchor is a mandatory word, no match is missed.

Every file is handled in its own row: nothing but the document frequencies of the templates'
words (one row per word) is shuffled. The list of templates is a parameter that becomes part
of the plan, so it is bounded by what the caller writes down.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import fresh

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"     # of text whose A-Z are lower-cased
GAP = WORD.replace("[^", "[")
KELVIN = "\u212A"                 # the one non-ASCII character that lower() makes a-z


class Template(NamedTuple):
    """``text`` is the wording, ``phrases`` the parts of it that a match must hold in full."""
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


#: Phrases and labels that the task fixes.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

#: Opening words of common licence notices.
NOTICES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright",
             ("possible under law", "waived all copyright")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             ("permission is hereby granted", "free of charge")),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software",)),
)


def words_in(text: str) -> list[str]:
    """The words of a template, as those of a file are taken."""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def mandatory(t: Template) -> list[tuple[int, str]]:
    """Positions and words of the template's key phrases (at their first place in it)."""
    words, out = words_in(t.text), {}
    for phrase in t.phrases:
        key = words_in(phrase)
        at = next((i for i in range(len(words) - len(key) + 1) if words[i:i + len(key)] == key), None)
        if at is None or not key:
            raise ValueError(f"template {t.label!r}: its text does not hold the phrase {phrase!r}")
        out |= {at + j: w for j, w in enumerate(key)}
    if not out:
        raise ValueError(f"template {t.label!r} has no mandatory phrase")
    return sorted(out.items())


def words(text: Column) -> Column:
    """Words of a text (null: none), A-Z lower-cased. Other letters are lower-cased, too, but
    never become or cease to be a-z, so they change neither bounds nor matches."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("æ")))
    return F.array_remove(F.split(low, GAP), "")       # only the first and last can be empty


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """Number of documents that hold each word of ``vocabulary``, over all documents."""
    if not vocabulary:
        return {}
    listed = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), listed)).alias("w"))
    return {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _index(templates: Sequence[Template], df: dict[str, int]) -> Column:
    """The postings: an array of templates, each under its rarest mandatory word."""
    def row(t: Template) -> Column:
        must = sorted(mandatory(t), key=lambda m: (df.get(m[1], 0), m[1], m[0]))
        (at, anchor), rest = must[0], must[1:]
        pairs = [F.struct(F.lit(j).alias("at"), F.lit(w).alias("w")) for j, w in must[:1] + rest]
        return F.struct(F.lit(anchor).alias("anchor"), F.lit(at).alias("at"), F.lit(t.label).alias("label"),
                        F.lit(t.base).alias("base"), F.array(*pairs).alias("must"),
                        F.array(*[F.lit(w) for w in words_in(t.text)]).alias("words"))
    return F.array(*[row(t) for t in templates])


def scan_licences(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, min_share: float = 0.5,
                  text_col: str = "text", words_col: str = "n_words",
                  matches_col: str = "licences") -> DataFrame:
    """``docs`` with the number of words of the whole text and the licence notices found in it:
    an array of ``(label, base, start, words, share)`` by start, where ``start`` counts words
    from 0 (negative if the text begins in the middle of the wording), ``words`` is the
    template's length and ``share`` the part of its words that stand in place. Mandatory
    phrases always do, and the share is at least ``min_share``; several templates may match
    at the same place.

    Defined cases: a null or empty text has no words and no matches. Rows with equal ids or
    texts are scanned each by itself, ids are not read. Other columns are passed through; if
    one of the new names is taken (in any case), ValueError. Without templates nothing
    matches; an empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    for c in (words_col, matches_col):
        if c.lower() in taken:
            raise ValueError(f"column {c!r} exists already")
    df = document_frequencies(docs, sorted({w for t in templates for _, w in mandatory(t)}), text_col)
    found = [t for t in templates if all(df.get(w, 0) for _, w in mandatory(t))]  # the others match nowhere
    split = fresh(docs, "_words")
    out = docs.withColumn(split, words(F.col(text_col)))
    kind = "array<struct<label:string,base:boolean,start:int,words:int,share:double>>"
    if not found:
        matches = F.array().cast(kind)
    else:
        index = _index(found, df)
        anchors = F.array(*[F.lit(w) for w in sorted({min(mandatory(t), key=lambda m: (df[m[1]], m[1], m[0]))[1]
                                                      for t in found})])
        w = F.col(split)

        def matched(p: Column, t: Column) -> Column:
            start = p - t["at"]
            inside = F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1),
                              lambda j: F.get(w, start + j) == F.get(t["words"], j))
            return F.struct(t["label"].alias("label"), t["base"].alias("base"), start.alias("start"),
                            F.size(t["words"]).alias("words"),
                            (F.size(inside) / F.size(t["words"])).alias("share"))

        def at_word(p: Column) -> Column:
            posted = F.filter(index, lambda t: (t["anchor"] == F.get(w, p)) & F.forall(
                t["must"], lambda m: F.coalesce(F.get(w, p - t["at"] + m["at"]) == m["w"], F.lit(False))))
            return F.transform(posted, lambda t: matched(p, t))

        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda p: F.array_contains(anchors, F.get(w, p)))
        hits = F.filter(F.flatten(F.transform(places, at_word)), lambda m: m["share"] >= min_share)
        ordered = F.array_sort(hits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                               .when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1)
                               .otherwise(a["words"] - b["words"]))
        # the index is walked only in files that hold an anchor
        matches = F.when(F.arrays_overlap(w, anchors), ordered).otherwise(F.array().cast(kind)).cast(kind)
    return out.select(*[F.col(c) for c in docs.columns], F.size(split).cast("bigint").alias(words_col),
                      matches.alias(matches_col))


def licence_digest(scanned: DataFrame, words_col: str = "n_words", matches_col: str = "licences") -> DataFrame:
    """Per document the number and bounds of the base places, the labels and the score (the
    largest share of a match, 0 without one)."""
    m = F.col(matches_col)
    base = F.filter(m, lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("bigint"))

    def names(a: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")

    return scanned.select(
        "doc_id", words_col, F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(m).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["share"])), F.lit(0.0)).alias("score"))


def licence_oracle_sql(templates: Sequence[Template] = BASE + NOTICES, min_share: float = 0.5) -> str:
    """The same result in SQL without an index: every template is tried at every word."""
    def quoted(items) -> str:
        return "[" + ", ".join(f"'{w}'" for w in items) + "]"

    rows = ",\n  ".join(
        f"('{t.label}', {str(t.base).lower()}, {quoted(words_in(t.text))}, "
        f"{[at for at, _ in mandatory(t)]}, {quoted(w for _, w in mandatory(t))})" for t in templates)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t(label, base, words, ats, must) AS (VALUES
  {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
c AS (SELECT r, label, base, words, i - ats[1] AS s, w, ats, must FROM p JOIN t ON w[i + 1] = must[1]),
m AS (SELECT r, label, base, s, len(list_filter(range(len(words)),
          lambda j: s + j >= 0 AND w[s + j + 1] = words[j + 1])) / len(words) AS share
      FROM c WHERE len(list_filter(range(len(ats)),
          lambda k: s + ats[k + 1] >= 0 AND w[s + ats[k + 1] + 1] = must[k + 1])) = len(ats)),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word,
        max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m WHERE share >= {min_share} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (r)"""
