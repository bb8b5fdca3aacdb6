"""Every registered query of the prose library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from prose_audit.plans import queries as Q

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in ("documents", "labels", "conversations", "pages", "benchmark"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return out


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows
    if name not in Q.ORACLE_SQL:
        return
    cursor = con.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    key = lambda r: tuple((x is not None, str(x) if not isinstance(x, float) else f"{x:.6f}") for x in r)
    got = sorted((tuple(r[c] for c in order) for r in rows), key=key)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (order, a, b)


def test_sql_is_of_queries():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


def test_splits_of_seeds(spark, con):
    """Every document's last paragraph is split as its seed says."""
    got = {}
    for r in Q.split_candidates(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (doc_id,) in con.execute("SELECT doc_id FROM documents").fetchall():
        text, split = Q.SPLIT_SEEDS[doc_id % len(Q.SPLIT_SEEDS)]
        own = [r for r in got.get(doc_id, []) if text.startswith(r.left)]
        assert [(r.kind, r.tier, r.start) for r in own] == ([split] if split else [])
        for r in own:
            assert text[: r.start] == r.left and text[r.end :] == r.right
