import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from prose_audit.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*map(said, (doc_id, source, lang, n_chars, text)))


def root_of(nodes):
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0]


def proof_of(nodes, at):
    out = []
    while len(nodes) > 1:
        start = at // 16 * 16
        out += [n for k, n in enumerate(nodes[start : start + 16], start) if k != at]
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return out


def plain(rows):
    """The contract, with every version's tree built anew."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for s in sources}
    leaves = {s: [leaf_of(r, r[1]) for r in own] for s, own in trees.items()}
    subroots = [root_of(leaves[s]) for s in sources]
    root, out = root_of(subroots), []
    for i, s in enumerate(sources):
        for k, r in enumerate(trees[s]):
            folded = root
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = r[1] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
                changed = root_of([*leaves[s][:k], leaf_of(r, text), *leaves[s][k + 1 :]])
                folded = root_of([*subroots[:i], changed, *subroots[i + 1 :]])
            proof = h(*proof_of(leaves[s], k), *proof_of(subroots, i))
            out.append((r[0], leaves[s][k], subroots[i], root, proof, folded, folded == root))
    return out


def random_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Abc ÉÄ", "plain", "Long " * 3000])
            rows.append((rng.choice([None, rng.randrange(-5, 10**6), rng.randrange(10**6)]), text, rng.choice(["de", None, "x:y"]), source, rng.choice([None, 3])))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {None: 1, "a": 300, "ä": 16, "Z": 2}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"big": 4500, "": 5}])
def test_against_trees_built_anew(spark, sizes):
    rows = random_rows(len(sizes), sizes)
    rows += rows[:2]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("leaf", F.lit(1)).withColumn("place", F.lit("x"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, M.check_rows(df).collect()), key=key) == sorted(plain(rows), key=key)


def test_versions_share_untouched_nodes(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 2}", k) for k in range(700)]
    got = M.manifest(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 50 == 0).collect()
    for r in got:
        if r.doc_id % 50:
            assert r.version is None
        else:  # a leaf, 350 rows in three levels, two sources in one
            assert [(v.level, v.place) for v in r.version] == [(0, r.place), (1, r.place // 16), (2, r.place // 256), (3, 0), (4, 0)]
            assert len({v.digest for v in r.version}) == 5
    block = M.Block([str(k) for k in range(40)], M.height(40))
    before = list(block.digests)
    copied = block.replace(20, "new")
    assert block.digests[: len(before)] == before and len(copied) == 3
    old, new = block.children[block.root], block.children[copied[-1]]
    assert old[0] == new[0] and old[2] == new[2] and new[1] == copied[1]


def test_empty_table(spark):
    assert M.check_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark):
    rows = random_rows(9, {"a": 300, None: 3, "é": 20})
    want = sorted(map(str, plain([r for r in rows if r[0] is not None])))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r for r in rows if r[0] is not None])
    assert sorted(map(str, con.execute(M.CHECK_SQL).fetchall())) == want
