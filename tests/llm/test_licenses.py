import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from prose_audit.llm import licenses as L

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows):
    """Every template tried at every place of every text."""
    known, texts = L.templates(), [words_of(t) for _, t in rows]
    lexicon = {w for k in known for w in k[1]}
    df = Counter(w for words in texts for w in set(words))
    order = sorted(lexicon, key=lambda w: (df[w], w))
    rarest = {min(k[1], key=order.index) for k in known if k[4]}
    out = []
    for (doc_id, _), words in zip(rows, texts):
        own = [w for w in order if w in set(words)]
        looked, found = {*own[: L.LOOKED_UP], *(rarest & set(own))}, []
        at = lambda i: words[i] if 0 <= i < len(words) else None
        for label, text, phrases, least, base in known:
            for start in range(-len(text), len(words)):
                agreed = sum(at(start + q) == w for q, w in enumerate(text) if w in looked)
                off = 0 if base else L.SLACK
                near = lambda q, p: any(words[max(0, start + q + d) : start + q + d + len(p)] == p for d in range(-off, off + 1) if start + q + d >= 0)  # noqa: B023, E731
                if agreed >= least and all(near(q, p) for q, p in phrases):
                    found.append((label, base, start, sum(at(start + q) == w for q, w in enumerate(text)) / len(text)))
        starts = [s for _, base, s, _ in found if base]
        label = lambda some: ",".join(sorted(set(some)))
        out.append((doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), label(x[0] for x in found if x[1]), label(x[0] for x in found), max((x[3] for x in found), default=0.0)))
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    pieces = [" ".join(k[1]) for k in L.templates()] + ["filler words of our own", "the GNU license, all of it", "CC-BY", "cc\x00by ccby CC by!", "é All Rights\nReserved ÄÖ", "general general public license public", "", "4 5 6"]
    pieces += [re.sub(" any| of| the", " ACME Inc.", p, count=1) for p in pieces] + [p[: len(p) // 2] for p in pieces]
    return [(k, " ".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for k in range(n)]


def test_against_every_place(spark):
    rows = [*random_texts(1, 120), (None, None), (None, "all rights reserved"), (5, "cc by"), (5, "cc by"), (6, "cc by " * 5000 + "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("found", F.lit(1)).withColumn("score", F.lit("x"))
    got, want = L.scan(df).drop("found").collect(), plain(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r[6] for r in want} >= {"", "cc-by"} and len({r[6] for r in want}) > 30


def test_base_places_are_all_found(spark):
    """Whatever else a file holds: it has all words of all templates here."""
    every = " ".join(" ".join(k[1]) for k in L.templates())
    text = f"all rights reserved {every} Cc.By general public license {every} all rights reserved"
    (got,) = L.scan(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    words = words_of(text)
    starts = [i for i in range(len(words)) for p in L.BASE if words[i : i + len(p.split())] == p.split()]
    assert (got.n_base, got.first_word, got.last_word, got.base_labels) == (len(starts), 0, len(words) - 3, "cc-by,gpl,reserved")


def test_filled_in_names(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files"
    (got,) = L.scan(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert got.labels == "mit" and got.base_labels == "" and 0.5 < got.score < 1
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql():
    rows = random_texts(2, 150)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(str, con.execute(L.SCAN_SQL).fetchall())) == sorted(map(str, plain(rows)))


def test_no_python_worker(spark):
    plan = L.scan(spark.createDataFrame([(1, "cc by")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
