import glob
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from prose_audit.llm import components, simhash


def brute_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_fingerprints(spark):
    texts = [None, "", "  ", "One", "one two", "É è A\xa0b C", "a b c d e f a b c", "x " * 70_000, "Été ÇA va bien\tmerci\x0bbeaucoup"]
    for t in texts:
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df, 3).collect()} == {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 22, 40)
    value = np.concatenate([base, *[base ^ (1 << rng.integers(0, 22, 40)) ^ (1 << rng.integers(0, 22, 40)) for _ in range(8)]])
    group = rng.integers(0, 3, len(value))
    rows = np.unique(np.stack([group, value], 1), axis=0)
    for budget in (0, 1, 2, 4):
        got = {p for i, j in simhash.trie_pairs(rows[:, 0], rows[:, 1], 22, budget) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i, j in combinations(range(len(rows)), 2) if rows[i][0] == rows[j][0] and int(rows[i][1] ^ rows[j][1]).bit_count() <= budget}


def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2001), (2000, 2001)] + [(3000, 3000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    pairs = {frozenset(x) for x in links}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert got == brute_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert components.connected_components(df.limit(0)).count() == 0


def documents(n=60, seed=4):
    rng = random.Random(seed)
    words = [rng.choice("bdfglmnprst") + rng.choice("aeiou") + rng.choice("bdlnrs") + str(i) for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 200))) for _ in range(n)]
    out = base + [b.upper() for b in base[:5]] + base[:4] + [None, "", " "]
    for b in base:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_components_equal_all_pairs(spark):
    texts = documents()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df, 3, 2).collect()}
    fp = {i: brute_fingerprint(t, 3) for i, t in enumerate(texts)}
    want = brute_components(range(len(texts)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in range(len(texts))}
    assert any(fp[a] != fp[b] and want[a] == want[b] for a, b in combinations(range(len(texts)), 2))
    assert simhash.simhash_components(df.limit(0), 3, 2).count() == 0


def test_keep_one(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(60, 400))) for _ in range(60)]
    texts = list(base)
    for b in base[:40]:
        w = b.split()
        for _ in range(max(1, len(w) // 100)):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", "  "]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)] + [(7, texts[7], "s", 7), (None, base[3], "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, node long")
    got = simhash.keep_one(df)
    assert got.columns == df.columns

    def sets(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    s = [sets(t) for t in texts]
    root = brute_components(range(len(texts)), lambda a, b: len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))
    want = sorted(set(root.values()))
    kept = sorted(r.doc_id for r in got.collect())
    assert kept == want
    assert simhash.keep_one(df.limit(0)).count() == 0


def word_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def check_kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    s = word_sets(texts)
    root = brute_components(range(len(texts)), lambda a, b: 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]))
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(root.values()))
    return len(set(root.values()))


def test_keep_one_short_texts(spark):
    rng = random.Random(11)
    texts = []
    for k in range(60):  # 5 shingles and 4 of them, 15 and 12
        w = [f"k{k}x{i}{rng.randrange(1000)}" for i in range(19)]
        texts += [" ".join(w[:9]), " ".join(w[:8])] if k % 2 else [" ".join(w), " ".join(w[:16])]
    assert check_kept(spark, texts) == 60


def variants(seed, n, length, least, most):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(3000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(length), rng.randrange(least, most + 1)):
            w[at] = f"r{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_keep_one_family_near_the_threshold(spark):
    assert check_kept(spark, variants(42, 100, 250, 3, 5)) > 1
    assert check_kept(spark, variants(42, 200, 400, 3, 8)) > 1


def test_keep_one_large_groups(spark):
    # texts that repeat one sentence: equal sets of shingles
    assert check_kept(spark, [" ".join(["one two three four five six seven"] * k) for k in range(3, 103)]) == 1
    # any two of these are similar: 2 of 300 words differ from the base at most, 1 of 120
    for texts in (variants(5, 1000, 300, 1, 2), variants(6, 6000, 120, 0, 1)):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        assert [r.doc_id for r in simhash.keep_one(df).collect()] == [0]


def test_sketch_pairs_lose_none():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(400):
        own = np.where(rng.random(60) < 0.08, rng.integers(0, 2**63, 60, dtype=np.uint64), base)
        sets.append(np.unique(own[: rng.integers(40, 61)]))
    sketch = np.stack([simhash.parity_sketch(s) for s in sets]).view(np.uint64)
    group, size = np.repeat([0, 1], 200), np.array([len(s) for s in sets])
    order = np.lexsort((sketch[:, 0], group))
    found = set()
    for i, j in simhash.sketch_pairs(group, sketch[order], size[order], 0.8):
        found |= {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
    for a, b in combinations(range(400), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if group[a] == group[b] and both >= 0.8 * (size[a] + size[b] - both):
            assert (a, b) in found
        if group[a] != group[b]:
            assert (a, b) not in found
    assert len(found) < 0.8 * 2 * 200 * 199 / 2


def test_blocks_of_a_frequent_shingle(spark, monkeypatch):
    """Tokens cut into blocks, forests before all pairs: the groups are those of a plain comparison."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 20)
    monkeypatch.setattr(simhash, "THIN_PAIRS", 1)
    assert check_kept(spark, variants(3, 150, 100, 1, 5)) > 1


def template_pages(seed, n, own):
    rng = random.Random(seed)
    shared = [f"menu{i}" for i in range(84)]
    return [" ".join([f"own{rng.randrange(10**7)}" for _ in range(own)] + shared) for _ in range(n)]


def test_pages_of_one_template_are_not_compared(spark, monkeypatch):
    texts = template_pages(1, 3000, 16)
    postings, real = [], simhash.shared_postings
    monkeypatch.setattr(simhash, "shared_postings", lambda *args: postings.append(real(*args)) or postings[-1])
    assert simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).count() == 3000
    assert postings[0].count() == 0


def test_templates_with_copies(spark, monkeypatch):
    """Rows of a token that lead and that don't, in the largest group and in others, in blocks of their own."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 10)
    monkeypatch.setattr(simhash, "THIN_PAIRS", 1)
    monkeypatch.setattr(simhash, "ROUNDS", 1)
    texts = template_pages(2, 60, 16) + template_pages(3, 60, 3) + template_pages(4, 40, 9) + template_pages(5, 30, 1)
    texts += [" ".join(t.split()[k % 5 :]) for k, t in enumerate(texts[:40])] + variants(9, 60, 60, 1, 4)
    assert 1 < check_kept(spark, texts) < len(texts)


def test_hot_stars_are_split(spark):
    """The join of a star's links with the stored minima is a plain shuffle on both sides, which adaptive execution splits."""
    from pyspark.sql import functions as F

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        star = spark.range(1, 60_001, numPartitions=6).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        for step in (components._large_star(star), components._small_star(star.select(F.col("v").alias("u"), F.col("u").alias("v")).union(star.selectExpr("100000 u", "v")))):
            plan = step.distinct()
            plan.collect()
            assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_spanning_keeps_what_links_join():
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 80, 120), rng.integers(0, 80, 120)
    few = simhash.spanning(i, j, rng.random(120), np.arange(80))
    assert (simhash.local_roots(80, i, j) == simhash.local_roots(80, i[few], j[few])).all() and len(few) < 80


def test_dense_blocks_are_thinned_within_bounds(spark, monkeypatch):
    """Ten tokens of 700 rows that are all alike: 2.4 million pairs, of which about CHUNK_PAIRS are held at once."""
    monkeypatch.setattr(simhash, "CHUNK_PAIRS", 50_000)
    monkeypatch.setattr(simhash, "map_batches", lambda df, run, *args, **more: run)
    placed = spark.createDataFrame([], "token long, x int, y int, node long, root long, side int, size int, pos int, n long, sketch array<long>")
    run = simhash.candidate_pairs(placed, 0.8, True)
    n = 7000
    token, node = np.repeat(np.arange(10), 700), np.arange(n)
    zero, size = np.zeros(n, np.int32), np.full(n, 200, np.int32)
    sketch = [np.random.default_rng(6).integers(0, 1 << 4, n) for _ in range(simhash.SKETCH_WORDS)]
    names = ["token", "x", "y", "node", "root", "side", "size", "pos", "n", *[f"s{k}" for k in range(simhash.SKETCH_WORDS)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (token, zero, zero, node, node, zero, size, zero, np.full(n, 700), *sketch)], names=names)
    held, real = [], simhash.spanning
    monkeypatch.setattr(simhash, "spanning", lambda i, *args: held.append(len(i)) or real(i, *args))
    links = pa.Table.from_batches(list(run(iter([batch])))).to_pydict()
    assert max(held) < 200_000
    i, j = (np.array([x for x in links[c] if x is not None]) for c in "uv")
    assert len(i) == n - 10 and (simhash.local_roots(n, i, j) == token * 700).all()
    assert sorted(x for x in links["token"] if x is not None) == list(range(10))


def test_few_links_are_in_few_files(spark):
    """Rounds of components over few links write no file for each shuffle partition."""
    root = spark.conf.get("spark.checkpoint.dir")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    seen = set(glob.glob(f"{root}/stars-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.range(1000).selectExpr("id u", "id + 1000 v")
        assert components.connected_components(links).count() == 2000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    new = set(glob.glob(f"{root}/stars-*")) - seen
    assert new and all(len(glob.glob(f"{x}/part-*")) <= spark.sparkContext.defaultParallelism for x in new)
