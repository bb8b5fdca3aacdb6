import random

from pyspark.sql import functions as F

from prose_audit.operators import corpus
from prose_audit.operators import phrase_mining as M
from prose_audit.plans import queries as Q

SCHEMA = "doc_id long, text string, good boolean"


def corpus_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(200)]
    rows = [(1, None, False), (2, "", None), (3, "one two", True), (4, "it's plain here it's plain here " * 200, False)]
    for k in range(n):
        text = rng.choices(words, k=rng.randrange(80))
        for phrase, share in (("at its core", 0.2), ("power of it", 0.1)):
            if rng.random() < (share if k % 3 else share / 5):
                text[rng.randrange(len(text) + 1) : 0] = phrase.split()
        rows.append((k % 50, " ".join(text).title(), k % 3 == 0))
    return rows


def plain(rows, n, least, ratio):
    import re

    seen = {True: {}, False: {}}
    for _, text, good in rows:
        w = re.findall(r"[a-z]+(?:'[a-z]+)*", (text or "").lower())
        for s in {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}:
            seen[bool(good)][s] = seen[bool(good)].get(s, 0) + 1
    studied, good = sum(not r[2] for r in rows), sum(bool(r[2]) for r in rows)
    return {s: (c, seen[True].get(s, 0)) for s, c in seen[False].items() if c >= least and c / studied >= ratio * (seen[True].get(s, 0) / max(1, good))}


def test_against_a_plain_count(spark):
    rows = corpus_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for n, share in ((3, 0.02), (2, 0.05), (3, 0.0)):
        got = M.mine_phrases(df, F.col("good"), n=n, least_share=share).collect()
        assert {r.phrase: (r.docs, r.good_docs) for r in got} == plain(rows, n, max(2, share * sum(not r[2] for r in rows)), 2.0)
    assert {"at its core"} == {r.phrase for r in M.mine_phrases(df, F.col("good"), least_share=0.05).collect()}
    assert M.mine_phrases(df.limit(0), F.col("good")).collect() == []


def test_sketch(spark):
    rows = corpus_rows(2)
    df = spark.createDataFrame(rows, SCHEMA)
    cells = 64
    whole = {r.cell: r.n for r in M.sketch(df, 3, cells).collect()}
    parts = M.merged(M.sketch(df.filter("doc_id < 20"), 3, cells), M.sketch(df.filter("doc_id >= 20"), 3, cells))
    assert {r.cell: r.n for r in parts.collect()} == whole and len(whole) <= M.DEPTH * cells
    exact = df.select(F.explode(M.sequences(F.col("text"), 3)).alias("s")).groupBy("s").count()
    for r in exact.select("count", *[M.cell(F.col("s"), k, cells).alias(f"c{k}") for k in range(M.DEPTH)]).collect():
        assert min(whole[r[f"c{k}"]] for k in range(M.DEPTH)) >= r["count"]


def test_quantile_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("class"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("day"), F.when(F.col("id") % 11 > 0, F.sqrt("id")).alias("total"))
    stored = corpus.score_sketches(rows, "class", "day")
    assert stored.count() == 21 and stored.select(F.max(F.length("sketch"))).first()[0] < 20_000
    out = corpus.rank_errors(corpus.sketch_thresholds(corpus.merged_sketches(stored, "class"), [0.01, 0.25, 0.5, 0.99]), rows, "class").collect()
    assert len(out) == 12 and all(r.rank_error <= corpus.RANK_ERROR for r in out)
    few = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "class string, total double")
    assert [(r["class"], r.docs) for r in corpus.score_sketches(few, "class").collect()] == [("a", 2)]


def test_scores_are_made_once(spark):
    """Readability is told once: neither the sketches, nor the ranks, nor the filters before them tell it again."""
    plan = Q.sketch_thresholds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
