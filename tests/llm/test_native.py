import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from prose_audit.llm import imatch, mixing

SMALL = "/root/testdata/sf0.001"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def xxh(value, seed):
    import xxhash

    return xxhash.xxh64_intdigest(value, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_terms(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).lower().split(" ") if w]
    return sorted({signed(xxh(w.encode(), 42)) for w in words})


def brute_fingerprint(text, kept):
    terms = [t for t in brute_terms(text) if t & (1 << 18) - 1 in kept]
    out = []
    for level in range(8):
        own = [t for t in terms if all(not t >> 21 + j & 1 for j in range(level))]
        for g in range(8):
            sub = [t for t in own if t >> 18 & 7 == g]
            h = 42
            for t in sub:  # a hash of an array goes over its values, each with the last hash as seed
                h = xxh((t & (1 << 64) - 1).to_bytes(8, "little"), h)
            out.append(1 + signed(h) % 65535 if sub else 0)
    return out


def brute_likeness(a, b):
    seen = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in seen) / len(seen) if seen else 1.0


TEXTS = [None, "", " \t", "Alpha beta", "the cat sat on the mat " * 30, "été Über naïve\nthe cat", "x" * 10_000, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "alpha beta"]


def check_edits(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_chars int").repartition(3)
    out = imatch.compare_with_edits(df)
    assert no_python(out)
    got = [tuple(r) for r in out.collect()]
    frequency = Counter(s for _, t in rows for s in {x & (1 << 18) - 1 for x in brute_terms(t)})
    kept = {s for s, n in frequency.items() if 2 <= n <= max(2, 0.08 * len(rows))}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxh((r[1] or "").encode(), 42))))
    want = []
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1]):
        text, other = text or "", other or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        a, b, c = (brute_fingerprint(t, kept) for t in (text, edited, other))
        digits = ["".join(f"{x:04x}" for x in f) for f in (a, b)]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *digits, brute_likeness(a, b), brute_likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_imatch_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 5))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 80)))) for i in range(90)]
    check_edits(spark, rows + [(None, "alpha beta the cat"), (103, rows[12][1]), (103, rows[12][1]), (-5, "alpha 😀 cat"), (None, None), (None, "beta gamma delta"), (None, "the cat alpha")])


def test_neighbours_equal_a_global_window(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    monkeypatch.setattr(imatch, "END_RUN", 4)
    rng = random.Random(12)
    rows = [(rng.choice([None, rng.randrange(-(2**63), 2**63), rng.randrange(900)]), rng.choice([None, "", f"t{i}", f"t{i} " * 9])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("tie_text", F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("tie_text"), "text"]
    first = F.first("tie_text").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    want = df.select("doc_id", "tie_text", F.coalesce(F.lead("tie_text").over(Window.orderBy(*order)), first)).collect()
    got = imatch.with_next(df, ["tie_text"]).select("doc_id", "tie_text", "next_tie_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    for size in (2**63 - 1, -(2**63)):  # one id only, at either end
        one = spark.createDataFrame([(size, "a")], "doc_id long, text string")
        assert [r.next_text for r in imatch.with_next(one, ["text"]).collect()] == ["a"]


def test_the_plan_of_neighbours_holds_no_ids(spark, monkeypatch):
    sizes = []
    for n in (40, 400):
        df = spark.range(n).selectExpr("id * 7919 doc_id", "repeat('w ', 50) text")
        monkeypatch.setattr(imatch, "RANGE_BYTES", 100)
        plan = imatch.with_next(df, ["text"])._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert sizes[1] - sizes[0] < 50


def test_imatch_few_rows(spark):
    check_edits(spark, [(1, "alpha beta gamma")])
    check_edits(spark, [(None, "alpha beta gamma"), (None, None)])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.compare_with_edits(df).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, todo = 1.5 * sum(sizes.values()), {}, set(sizes)
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in todo}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        todo -= over
    return target


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 50), rng.choice(["s0"] * 6 + ["s1", "S2", "é", "", None])) for i in range(400)]
    rows += [(1000, None, "nothing"), (1001, "", "nothing"), (None, "a b c", "s1"), (7, rows[7][1], rows[7][2]), (2000, "x " * 3000, "big"), (2001, "y", "big")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(df)
    assert no_python(out)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] += r.taken
    for s in target:
        assert abs(taken[s] - target[s]) <= 1
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and [r.position for r in got][: len(placed)] == placed
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_positions_invert_the_integral(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 101).select((F.col("id") / 100).alias("q"))
    for begin in mixing.BEGIN:
        for r in df.select("q", mixing.position(F.col("q"), F.lit(begin)).alias("t")).collect():
            assert begin * r.t + (1 - begin) * r.t**2 == pytest.approx(r.q, abs=1e-9)


def test_mix_equals_sql(spark):
    got = sorted(map(tuple, mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(mixing.MIX_SQL).fetchall())
    assert got == want
