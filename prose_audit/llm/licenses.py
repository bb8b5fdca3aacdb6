"""License scans by a positional index of rare tokens, in DataFrame functions only.

A template is the words of a licence text or notice. The index has for each of their words the templates and the
positions that hold it. Document frequencies of these words are counted over all files and order them. Of a file the
LOOKED_UP words with the highest inverse document frequency, and the rarest word of each base phrase, are looked up;
the postings are intersected by relative position: each occurrence votes for the start that the template would have,
and a start with enough votes is a candidate. It counts if all mandatory phrases of the template stand near their places.
A base phrase is a template of its own whose one phrase is the whole, so that its rarest word finds all its places.

The index is as large as the fixed templates and lies in the plan; all that is gathered on the driver is one count for each
of its words. A file is scanned in its row, so nothing is shuffled but those counts; work is linear in a file's words.

Defined cases: a null or empty text has no words, no labels and a score of 0; very long texts are scanned whole; repeated
rows, null and equal doc_ids are rows of their own; an empty table gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .imatch import let
from .merkle import CAPITALS, SMALL

#: Characters between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a file that are looked up, beside the rarest of each base phrase.
LOOKED_UP = 16
#: Words by which a mandatory phrase may be off its place: names and years are filled into licences.
SLACK = 6
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates: label, words, mandatory phrases, words that must agree on the place.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"], 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"], 3),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"], 2),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"], 2),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"], 2),
    ("gpl-any", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it", "gnu general public license"], 3),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"], 2),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"], 2),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"], 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"], 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"], 3),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"], 3),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"], 2),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ["creative commons attribution noncommercial"], 2),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright", "related or neighboring rights"], 3),
]
#: In a vote the template stands above these bits, the start plus OFFSET in them.
PLACE_BITS, OFFSET = 33, 1024


def templates() -> list[tuple[str, list[str], list[tuple[int, list[str]]], int, bool]]:
    """label, words, mandatory phrases with their places, least agreeing words, whether it is a base phrase."""
    out = [(label, phrase.split(), [(0, phrase.split())], 1, True) for phrase, label in BASE.items()]
    for label, text, phrases, least in TEMPLATES:
        words, placed = text.split(), []
        for phrase in phrases:
            own = phrase.split()
            placed.append((next(i for i in range(len(words)) if words[i : i + len(own)] == own), own))
        out.append((label, words, placed, least, False))
    return out


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), GAP), lambda w: w != "")


def ranked_words(docs: DataFrame) -> list[str]:
    """The words of all templates, that in the fewest documents first, equal ones by the word."""
    known = sorted({w for _, words, _, _, _ in templates() for w in words})
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(known)))).alias("word"))
    counts = {r.word: r["count"] for r in found.groupBy("word").count().collect()}  # one row for each word of the templates
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


def matches(words: Column, lexicon: list[str]) -> Column:
    """Templates found in ``words``: array of struct<template, start, share>, the share of its words in their places."""
    known = templates()
    number = {w: i for i, w in enumerate(lexicon)}
    postings = F.array(*[F.array(*[F.lit((t << PLACE_BITS) + OFFSET - q) for t, (_, own, _, _, _) in enumerate(known) for q, x in enumerate(own) if x == w]) for w in lexicon])
    rarest = ints(sorted({min(number[w] for w in own) for _, own, _, _, base in known if base}))
    least = ints([k[3] for k in known])
    slack = [F.lit(0), *[F.lit(0 if k[4] else SLACK) for k in known]]
    texts = F.array(*[F.array(*map(F.lit, k[1])) for k in known])
    phrases = F.array(*[F.array(*[F.struct(F.lit(q).alias("at"), F.array(*map(F.lit, own)).alias("words")) for q, own in k[2]]) for k in known])
    names = F.array(*map(F.lit, lexicon))

    def looked_up(hits: Column) -> Column:
        ids = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["id"])))
        return F.array_union(F.slice(ids, 1, LOOKED_UP), F.array_intersect(ids, rarest))

    def votes(hits: Column) -> Column:
        own = let(looked_up(hits), lambda ids: F.filter(hits, lambda h: F.array_contains(ids, h["id"])))
        return F.array_sort(F.flatten(F.transform(own, lambda h: F.transform(F.get(postings, h["id"]), lambda x: x + h["at"]))))

    def agreed(all_votes: Column) -> Column:
        template = lambda x: F.shiftright(x, PLACE_BITS).cast("int")
        same = F.filter(all_votes, lambda x, i: F.get(all_votes, i + F.get(least, template(x)) - 1) == x)
        return F.transform(F.array_distinct(same), lambda x: F.struct(template(x).alias("template"), (x.bitwiseAND((1 << PLACE_BITS) - 1) - OFFSET).cast("int").alias("start")))

    def stands(own: Column, at: Column) -> Column:
        return F.forall(F.transform(own, lambda w, j: F.coalesce(F.get(words, at + j) == w, F.lit(False))), lambda same: same)

    def verified(c: Column) -> Column:
        off = F.element_at(F.array(*slack[1:]), c["template"] + 1)
        return F.forall(F.get(phrases, c["template"]), lambda p: F.exists(F.sequence(-off, off), lambda d: stands(p["words"], c["start"] + p["at"] + d)))

    def scored(c: Column) -> Column:
        own = F.get(texts, c["template"])
        same = F.filter(F.transform(own, lambda w, j: F.get(words, c["start"] + j) == w), lambda same: same)
        return F.struct(c["template"].alias("template"), c["start"].alias("start"), (F.size(same) / F.size(own)).alias("share"))

    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(lexicon), i)), lambda i: i.isNotNull())
    hits = F.transform(places, lambda i: F.struct(i.alias("at"), (F.array_position(names, F.get(words, i)) - 1).cast("int").alias("id")))
    candidates = let(hits, lambda h: let(votes(h), agreed))
    return F.transform(F.filter(candidates, verified), scored)


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found: the
    templates, by number, with their starts and shares."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, lexicon = templates(), ranked_words(own)
    both = let(words_of(F.col("text")), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), matches(words, lexicon).alias("found")))
    label = F.array(*[F.lit(k[0]) for k in known])
    base = lambda: F.filter("found", lambda m: m["template"] < len(BASE))
    starts = F.transform(base(), lambda m: m["start"].cast("long"))
    named = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: F.get(label, m["template"])))), ",")
    rows = own.select("doc_id", both.alias("scan")).select("doc_id", "scan.n_words", "scan.found")
    score = F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base()).alias("base_labels"), named(F.col("found")).alias("labels"), score.alias("score"), "found",
    )


def _sql() -> str:
    """The same rows as SQL over ``documents``; doc_ids are to be different."""
    known = templates()
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    kinds = values([(t, label, least, len(words), base, 0 if base else SLACK) for t, (label, words, _, least, base) in enumerate(known)])
    postings = values([(t, q, w) for t, k in enumerate(known) for q, w in enumerate(k[1])])
    phrases = values([(t, n, q + j, w, len(own)) for t, k in enumerate(known) for n, (q, own) in enumerate(k[2]) for j, w in enumerate(own)])
    return rf"""
WITH kinds(t, label, least, size, base, slack) AS (VALUES {kinds}),
postings(t, q, w) AS (VALUES {postings}),
phrases(t, phrase, q, w, n) AS (VALUES {phrases}),
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
hits AS (SELECT * FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM cut) WHERE w IN (SELECT w FROM postings)),
ranked AS (SELECT w, row_number() OVER (ORDER BY n, w) AS rank FROM (SELECT w, count(DISTINCT h.doc_id) AS n FROM (SELECT DISTINCT w FROM postings) LEFT JOIN hits h USING (w) GROUP BY w)),
rarest AS (SELECT min_by(w, rank) AS w FROM postings JOIN kinds USING (t) JOIN ranked USING (w) WHERE base GROUP BY t),
looked AS (
  SELECT doc_id, w FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS nth FROM (SELECT DISTINCT doc_id, w FROM hits) JOIN ranked USING (w))
  WHERE nth <= {LOOKED_UP} OR w IN (SELECT w FROM rarest)),
candidates AS (
  SELECT doc_id, t, p - q AS start FROM hits JOIN looked USING (doc_id, w) JOIN postings USING (w) JOIN kinds USING (t)
  GROUP BY doc_id, t, p - q, least HAVING count(*) >= least),
near AS (
  SELECT doc_id, t, c.start, phrase, h.p - q AS at, n FROM candidates c JOIN kinds USING (t) JOIN phrases USING (t) JOIN hits h USING (doc_id, w)
  WHERE abs(h.p - q - c.start) <= slack GROUP BY doc_id, t, c.start, phrase, h.p - q, n HAVING count(*) = n),
verified AS (
  SELECT doc_id, t, start FROM near GROUP BY doc_id, t, start HAVING count(DISTINCT phrase) = (SELECT count(DISTINCT phrase) FROM phrases f WHERE f.t = near.t)),
found AS (
  SELECT doc_id, t, v.start, label, base, count(*) / size AS share FROM verified v JOIN kinds USING (t) JOIN postings USING (t) JOIN hits h USING (doc_id, w)
  WHERE h.p = v.start + q GROUP BY doc_id, t, v.start, label, base, size),
summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM cut LEFT JOIN summed USING (doc_id)
"""


SCAN_SQL = _sql()
