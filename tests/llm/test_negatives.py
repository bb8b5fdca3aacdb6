import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prose_audit.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """The contract, by all scores of an anchor."""
    ok = lambda r: r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    own = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in rows if ok(r)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, (a, u, label) in enumerate(own):
        if a is None or not anchor(a):
            continue
        scores = [(sum(x * y for x, y in zip(u, v)), b, m) for k, (b, v, m) in enumerate(own) if k != i]
        for p in sorted((t for t in scores if t[2] == label), key=order)[:positives]:
            fit = sorted((t for t in scores if t[2] != label and low * p[0] <= 100 * t[0] <= high * p[0]), key=order)[:negatives]
            out += [(a, p[1], k, t[1], p[0], t[0]) for k, t in enumerate(fit, 1)]
    return sorted(out, key=str)


def vectors(seed, n, dims, labels, scale=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, dims))
    rows = []
    for k in range(n):
        label = int(rng.integers(labels)) if k % 3 else 0  # a third has one label
        v = 0.7 * centers[label] + rng.normal(size=dims)
        rows.append((k, (scale * v / np.linalg.norm(v)).tolist(), label))
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_against_all_scores(spark, monkeypatch, scale):
    monkeypatch.setattr(N, "MOST_ROWS", 64)
    rows = vectors(4, 400, 20, 4, scale)
    got = N.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 7 == 0).collect()
    want = plain(rows, lambda a: a % 7 == 0)
    assert len(want) > 200 and sorted(map(tuple, got), key=str) == want


def test_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (5, [1.0, 0.5], 1), (None, [1.0, 0.5], 1), (50, [1.0], 2), (51, [0.6], 1), (52, [0.7, 0.1], 2), (52, [0.7, 0.1], 2), (53, [0.7, 0.1], 3)]
    rows += [(100, None, 1), (100, [1.0, None], 1), (100, [nan, 1.0], 1), (100, [inf, 1.0], 2), (100, [1.0, 1.0], None), (150, [], 1), (200, [0.0, 0.0], 9), (250, [-1.0, -1.0], 1)]
    rng = random.Random(1)
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
        assert sorted(map(tuple, N.mine(df, F.col("vec_id") % 50 == 0).collect()), key=str) == plain(rows, lambda a: a % 50 == 0)
    assert N.mine(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert N.mine(df, F.col("vec_id") == 7).collect() == []


def test_scan_prunes():
    """Most candidates go before the last dimensions are read."""
    rows = vectors(2, 2000, 64, 10)
    values = np.floor(256 * np.array([r[1] for r in rows]).T)
    order = np.argsort([r[2] for r in rows], kind="stable")
    row = {"ids": np.arange(2000).tobytes(), "rows": np.arange(2000).tobytes(), "labels": np.array([r[2] for r in rows])[order].tobytes(), "values": values[:, order].astype("<i2").tobytes(), "wide": False, "dims": 64}
    block = N.Vectors({f"b_{k}": v for k, v in row.items()}, "b")
    scan, left = N.Scan(block, block), []
    scores = block.values[:, 0].astype(int) @ block.values.astype(int)
    best = np.sort(scores[1:])[-5]

    def keep(low, high):
        left.append(len(low))
        assert (low <= high).all()
        return high >= N.largest(low, 5)

    found, exact = scan.survivors(block.values[:, 0], np.arange(1, 2000), keep)
    assert left[-1] < left[0] / 4 and set(np.flatnonzero(scores >= best)[1:]) <= set(found) and (exact == scores[found]).all()


def test_sql():
    rows = vectors(8, 300, 16, 4)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(con.execute(N.MINE_SQL).fetchall(), key=str) == plain(changed, lambda a: a % 50 == 0)
