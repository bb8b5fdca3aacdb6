import random

import numpy as np
from pyspark.sql import functions as F

from prose_audit.operators import corpus, diff, flags, nearest, rewrite
from prose_audit.sources.rules import default_rules

VECTORS = "row long, v array<double>"


def test_against_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "CHUNK", 50)
    centers = 4 * rng.normal(size=(6, 4))
    authors = [(f"a{k:03}", (np.round(2 * (centers[k % 6] + rng.normal(size=4))) / 2).tolist()) for k in range(400)] + [("tie1", [0.0] * 4), ("tie0", [0.0] * 4)]
    docs = [(k, (np.round(2 * (centers[0 if k % 3 == 0 else k % 6] + rng.normal(size=4))) / 2).tolist()) for k in range(300)] + [(300, [0.0] * 4)]
    a = spark.createDataFrame(authors, "author_id string, v array<double>").repartition(3)
    d = spark.createDataFrame(docs, VECTORS).repartition(3)
    for k in (1, 4, 20):
        got = {}
        for r in nearest.nearest_vectors(d, a, k, 4).collect():
            got.setdefault(r.row, {})[r["rank"]] = (r.author_id, r.delta)
        for row, v in docs:
            want = sorted((round(float(np.abs(np.array(x) - v).mean()), 9), n) for n, x in authors)[:k]
            assert [(round(got[row][i + 1][1], 9), got[row][i + 1][0]) for i in range(k)] == want
    assert nearest.nearest_vectors(d, a.limit(0), 2, 4).collect() == []
    assert nearest.nearest_vectors(d.limit(0), a, 2, 4).collect() == []


def test_rounded_distances_are_ranked(spark, monkeypatch):
    """Distances that are equal when rounded are ordered by author, also of blocks that are a little further off."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(nearest, "BLOCK", 4)
    authors = [(f"a{99 - k:02}", [0.1 + 0.0004 * k]) for k in range(60)] + [(f"b{k:02}", [float(x)]) for k, x in enumerate(rng.random(40))]
    docs = [(k, [float(x)]) for k, x in enumerate([0.0, *rng.random(60)])]
    a, d = spark.createDataFrame(authors, "author_id string, v array<double>"), spark.createDataFrame(docs, VECTORS)
    got = {}
    for r in nearest.nearest_vectors(d, a, 3, 1, digits=2).collect():
        got.setdefault(r.row, []).append((r["rank"], r.delta, r.author_id))
    for row, (own,) in docs:
        want = sorted((float(np.floor(abs(x - own) * 100 + 0.5) / 100), n) for n, (x,) in authors)[:3]
        assert [x[1:] for x in sorted(got[row])] == want


def test_few_blocks_are_asked(spark, monkeypatch):
    """No pairs of all documents and authors: most blocks are ruled out by their bounds."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    centers = 20 * rng.normal(size=(8, 5))
    a = spark.createDataFrame([(f"a{k}", (centers[k % 8] + rng.normal(size=5)).tolist()) for k in range(800)], "author_id string, v array<double>")
    d = spark.createDataFrame([(k, (centers[k % 8] + rng.normal(size=5)).tolist()) for k in range(200)], VECTORS)
    asked, plain = [], nearest._stored
    monkeypatch.setattr(nearest, "_stored", lambda df, what: (out := plain(df, what), what == "asked" and asked.append(out.count()))[0])
    nearest.nearest_vectors(d, a, 3, 5).collect()
    blocks = 800 // 16
    assert sum(asked) < 200 * blocks / 3


def test_as_style_distance(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(corpus.FUNCTION_WORDS[:30] + ["noun", "verb"], k=rng.randrange(60)))
    docs = spark.createDataFrame([(k, text()) for k in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    base = spark.createDataFrame([(f"w{k % 5}", text()) for k in range(20)] + [("none", None)], "author_id string, text string")
    all_pairs = {}
    for r in corpus.style_distance(docs, base).collect():
        all_pairs.setdefault(r.doc_id, []).append((round(r.delta, 9), r.author_id))
    got = {}
    for r in nearest.nearest_authors(docs, base, 2).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], round(r.delta, 9), r.author_id))
    assert len(got) == 42
    for doc_id, own in got.items():
        assert [x[1] for x in sorted(own)] == [x[0] for x in sorted(all_pairs[doc_id])[:2]]


def test_long_differences():
    """In little memory, as short as by the whole table, and both texts come out of the steps."""
    rng = random.Random(4)
    for n in (5, 60, 300):
        a = [rng.choice("abcdefgh") for _ in range(n)]
        b = [x for x in a if rng.random() < 0.9] + [rng.choice("abcdefgh") for _ in range(n // 5)]
        plain, cells = diff._longest_common(a, b), diff.TABLE_CELLS
        try:
            diff.TABLE_CELLS = 20
            steps = diff._steps(a, b)
        finally:
            diff.TABLE_CELLS = cells
        assert [w for op, w in steps if op != "add"] == a and [w for op, w in steps if op != "del"] == b
        assert sum(op == "keep" for op, _ in steps) == sum(op == "keep" for op, _ in plain)
    words = [f"w{k % 997}" for k in range(6000)]
    other = [w for k, w in enumerate(words) if k % 50] + ["end"]
    ops = diff.difference(" ".join(words), " ".join(other), None)
    assert sum(op == "del" for op, _ in ops) >= 120 and "".join(t for op, t in ops if op != "del") == " ".join(other)
    assert diff.difference(" ".join(words), " ".join(other))[0][0] == "skip"


def test_totals_count_documents_once(spark):
    """A doc_id under two sources is one document in all."""
    docs = spark.createDataFrame([(1, "We utilize it;", "a"), (1, "We utilize it;", "b"), (2, "We utilize it;", "b")], "doc_id long, text string, source string")
    done = rewrite.rewrite_documents(docs, default_rules())
    got = {(r.source, r.category): (r.n, r.docs) for r in rewrite.changes_by_category(done, "source").collect()}
    assert got[(None, "Simpler word")] == (3, 2) and got[("b", "Simpler word")] == (2, 2)
    flagged = flags.flag_documents(docs, default_rules())
    got = {(r.source, r.type): (r.n, r.docs) for r in flags.flags_by_type(flagged, "source").collect()}
    assert got[(None, "Semicolon")] == (3, 2) and got[("a", "Semicolon")] == (1, 1)
