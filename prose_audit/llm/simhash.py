"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are sorted, so a trie node is a range of rows. Pairs of nodes are traversed together, level
by level, adding up differing bits; a pair over the Hamming budget is pruned with everything below it.
Tasks get independent parts of the trie: a part holds the fingerprints that agree on some blocks of bits,
and pigeonholes (any two fingerprints within the budget agree on enough blocks) make the parts complete.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and is linked like
any other; a text with fewer words than a shingle is one shingle; repeated rows have equal fingerprints;
an empty table gives no rows. Other columns of the input are dropped or, by ``keep_one``, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, map_batches, numbered_rows, stored
from .components import connected_components

SEED = 42
#: Blocks of a 64-bit fingerprint: two within 2 bits agree on 4 of 6 at least, so a part shares 42 bits or
#: more and holds 2**22 distinct fingerprints at most, however many documents are copies.
BLOCKS, AGREED = (11, 11, 11, 11, 10, 10), 4
#: Rows, and node pairs, that are worked on at once in a task.
CHUNK_ROWS, CHUNK_PAIRS = 100_000, 1_000_000

# Near-duplicates by similarity: one in SAMPLED texts tells frequent shingles. Rows of a shingle are searched in
# blocks of BLOCK_ROWS; of a block with over THIN_PAIRS pairs a row, ROUNDS rounds check a forest only before all
# pairs that are still between two groups are checked.
SAMPLED, HOT_SHINGLES, BLOCK_ROWS, THIN_PAIRS, ROUNDS = 8, 50_000, 2048, 8, 1
SKETCH_WORDS, LEAF_PAIRS = 4, 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lower-cased, joined by spaces, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """64 booleans, most significant bit first: set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        count += bits.sum(0, dtype=np.int32)
    return 2 * count > len(hashes)


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint."""
    return int.from_bytes(np.packbits(majority(shingle_hashes(text, words))).tobytes(), "big")


def trie_pairs(group: np.ndarray, value: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose values differ in ``budget`` of the low ``bits`` bits at most.

    Rows are sorted by (group, value) and distinct. Every group is the root of a trie; the frontier of
    node pairs is cut into blocks, so memory is bounded.
    """
    n = len(value)
    if n < 2:
        return
    value = value.astype(np.uint64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([start[1:], [n]])
    ones = [np.concatenate([[0], np.cumsum((value >> np.uint64(b)) & np.uint64(1))]).astype(np.int64) for b in range(bits)]
    many = end - start > 1
    root = (start[many], end[many], start[many], end[many], np.zeros(int(many.sum()), np.int8))
    stack = [(bits - 1, root)]
    while stack:
        level, (alo, ahi, blo, bhi, diff) = stack.pop()
        if len(alo) > CHUNK_PAIRS:
            half = len(alo) // 2
            stack += [(level, tuple(x[half:] for x in (alo, ahi, blo, bhi, diff))), (level, tuple(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1) & (alo != blo)
        if single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            if near.any():
                yield np.minimum(i, j)[near], np.maximum(i, j)[near]
        go = ~single & ~((alo == blo) & (ahi - alo == 1))
        if level < 0 or not go.any():
            continue  # below the last bit the values are equal, so nodes are single rows
        alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        one = ones[level]
        amid = ahi - (one[ahi] - one[alo])
        bmid = bhi - (one[bhi] - one[blo])
        same = (alo == blo) & (ahi == bhi)
        cross = ~same
        parts = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], diff[cross] + 1),
        ]
        nodes = [np.concatenate(x) for x in zip(*parts)]
        keep = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (nodes[4] <= budget)
        stack.append((level - 1, tuple(x[keep] for x in nodes)))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive batches, cut where the first ``keys`` columns change, about CHUNK_ROWS each."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        change = np.zeros(rows - 1, bool)
        for c in columns[:keys]:
            change |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            at = int(cut[-1]) + 1
            yield [c[:at] for c in columns]
            columns = [c[at:] for c in columns]
        held, rows = [columns], len(columns[0])
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _group_ids(columns: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, fp (the 64-bit fingerprint as a signed long)."""

    def step(c: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(t, words) for t in c["text"]], np.uint64).view(np.int64)
        return {"doc_id": c["doc_id"], "fp": fps}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, "doc_id long, fp long")


def _masks() -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of agreeing blocks: the mask of their bits, and (shift, width) of the others."""
    shift, at = [], 64
    for width in BLOCKS:
        at -= width
        shift.append(at)
    out = []
    for agreed in combinations(range(len(BLOCKS)), AGREED):
        mask = sum(((1 << BLOCKS[b]) - 1) << shift[b] for b in agreed)
        out.append((mask, [(shift[b], BLOCKS[b]) for b in range(len(BLOCKS)) if b not in agreed]))
    return out


def hamming_links(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Links (u, v) whose components are those of "``budget`` differing bits at most" among distinct ``fp``.

    Of each part of the trie a link from every fingerprint to the smallest one it reaches is kept, so the
    links are fewer than fingerprints times parts, however dense they lie.
    """
    if budget > len(BLOCKS) - AGREED:
        raise ValueError("the blocks are made for 2 differing bits")
    masks = _masks()
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in masks]
    parts = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("c", "key")
    rows = fps.select("fp", parts).select("c", "key", "fp").repartition("c", "key").sortWithinPartitions("c", "key")
    out = arrow_schema(fps.sparkSession, "u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, key, fp in _whole_groups(batches, 2):
            raw, rest = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
            for k in np.unique(c):
                of = c == k
                for shift, width in masks[k][1]:
                    rest[of] = rest[of] << np.uint64(width) | raw[of] >> np.uint64(shift) & np.uint64((1 << width) - 1)
            group = _group_ids([c, key])
            order = np.lexsort((rest, group))
            group, rest, fp = group[order], rest[order], fp[order]
            found = list(trie_pairs(group, rest, max(sum(w for _, w in m[1]) for m in masks), budget))
            if found:
                root = local_roots(len(fp), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                linked = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], schema=out)

    return map_batches(rows, run, "u long, v long", rows=20_000)


def simhash_components(docs: DataFrame, words: int = 5, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reached by links of ``budget`` bits."""
    fps = stored(fingerprints(docs, words), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(hamming_links(distinct.select("fp"), budget))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components"), "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------------------------------------------
# near-duplicates by similarity of shingle sets


def least_overlap(size: int, similarity: float) -> int:
    """Shingles that a set of ``size`` shares at least with any set that is this similar."""
    return int(np.ceil(similarity * size - 1e-6))


def prefix(hashes: np.ndarray, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles of a set, in an order that is the same for all sets: two sets that are this similar
    share one of these. ``hot`` is sorted hashes and their ranks; they come last, so that a prefix is seldom
    made of shingles of many texts. Also how many of the first shingles aren't hot."""
    token, rank = hot
    order, cold = hashes, len(hashes)
    if len(token) and len(hashes):
        at = np.minimum(np.searchsorted(token, hashes), len(token) - 1)
        last = np.where(token[at] == hashes, rank[at] + 1, 0)
        order, cold = hashes[np.lexsort((hashes, last))], int((last == 0).sum())
    n = len(hashes) - least_overlap(len(hashes), similarity) + 1 if len(hashes) else 0
    return order[:n], min(n, cold)


def hot_shingles(texts: DataFrame, words: int, share: int = SAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of every ``share``-th text, HOT_SHINGLES at most: sorted hashes, and ranks by frequency.

    They only shape the order of shingles; any choice gives the same links.
    """

    def step(c: dict[str, list]) -> dict[str, list]:
        found = [np.unique(shingle_hashes(t, words)) for t in c["text"]]
        return {"token": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)}

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    counts = map_arrow(some, step, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 2")
    rows = counts.orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).select("token").collect()
    token = np.array([r.token for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.arange(len(token))[order]


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """256 bits, as signed longs: a bit is the parity of the shingles that fall on it. So the sketches of two sets
    differ in no more bits than the sets have shingles that only one of them has."""
    odd = np.bincount((hashes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def leads(similarity: float) -> Column:
    """Whether a set of ``size`` whose first shared shingle is at ``pos`` has enough left for a set as large as itself.

    Of two similar sets the smaller one leads at the first shingle that they share, since the larger one only asks for
    more. So rows of a shingle that don't lead need not meet each other.
    """
    return F.col("size") - F.col("pos") >= F.ceil(2 * F.col("size") * F.lit(similarity / (1 + similarity)) - 1e-6)


def shared_postings(distinct: DataFrame, similarity: float) -> DataFrame:
    """``distinct(node, size, prefix, cold, sketch)`` → token, node, size, pos, sketch and n, the rows of the token: of
    the prefixes what two nodes have at least and one of them leads with. Shingles of common boilerplate, which come
    late in every set that has own ones, drop out here.

    The HOT_SHINGLES, whose counts are broadcast, aren't moved for that. A shingle that isn't one of them is
    rarer than each of those, in the sample at least, so its rows are counted in a window.
    """
    rows = distinct.select("node", "size", "cold", F.posexplode("prefix").alias("pos", "token")).withColumn("leads", leads(similarity))
    of_token = Window.partitionBy("token")
    rare = rows.filter("pos < cold").select("token", "node", "pos", F.count("*").over(of_token).alias("n"), F.max("leads").over(of_token).alias("led"))
    hot = rows.filter("pos >= cold").select("token", "node", "pos", "leads")
    counts = hot.groupBy("token").agg(F.count("*").alias("n"), F.max("leads").alias("led")).filter("n > 1 and led")
    both = rare.filter("n > 1 and led").drop("led").union(hot.join(F.broadcast(counts), "token").select("token", "node", "pos", "n"))
    return both.join(distinct.select("node", "size", "sketch"), "node").select("token", "node", "size", "pos", "sketch", "n")


def _ranges(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j of pairs of ranges, about CHUNK_PAIRS at once."""
    width = bhi - blo
    n = (ahi - alo) * width
    ends = np.cumsum(n)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]), CHUNK_PAIRS))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)]):
        if a == b:
            continue
        own = np.repeat(np.arange(a, b), n[a:b])
        off = np.arange(len(own)) - np.repeat(ends[a:b] - n[a:b] - (ends[a] - n[a]), n[a:b])
        i, j = alo[own] + off // width[own], blo[own] + off % width[own]
        up = i < j
        yield i[up], j[up]


def sketch_pairs(group: np.ndarray, sketch: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group that may be this similar by size and sketch; none that is gets lost.

    Sets of sizes a and b with Jaccard similarity s differ in (a + b)(1 - s)/(1 + s) shingles at most, which bounds
    the differing bits of their sketches. Rows are sorted by group and first sketch word; pairs of nodes of the trie
    over that word are traversed together and pruned when the bits that differ so far are over the budget of
    the group's largest set. Pairs of small nodes, and those below the last bit, are compared row by row.
    """
    spread = (1 - similarity) / (1 + similarity)
    n = len(group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([start[1:], [n]])
    most = np.floor(2 * np.maximum.reduceat(size, start) * spread + 1e-6).astype(np.int64)
    word = sketch[:, 0]
    ones = [np.concatenate([[0], np.cumsum((word >> np.uint64(b)) & np.uint64(1))]).astype(np.int32) for b in range(64)]
    several = end - start > 1
    stack = [(63, (start[several], end[several], start[several], end[several], np.zeros(int(several.sum()), np.int64), most[several]))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes[0]) > CHUNK_PAIRS:
            half = len(nodes[0]) // 2
            stack += [(level, tuple(x[half:] for x in nodes)), (level, tuple(x[:half] for x in nodes))]
            continue
        alo, ahi, blo, bhi, diff, most = nodes
        leaf = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS if level >= 0 else np.ones(len(alo), bool)
        if leaf.any():
            for i, j in _ranges(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf]):
                both = size[i] + size[j]
                ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
                i, j, both = i[ok], j[ok], both[ok]
                ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= np.floor(both * spread + 1e-6)
                if ok.any():
                    yield i[ok], j[ok]
        alo, ahi, blo, bhi, diff, most = (x[~leaf] for x in nodes)
        if not len(alo):
            continue
        one = ones[level]
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        cross = (alo != blo) | (ahi != bhi)
        parts = [
            (alo, amid, blo, bmid, diff, most),
            (amid, ahi, bmid, bhi, diff, most),
            (alo, amid, bmid, bhi, diff + 1, most),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], diff[cross] + 1, most[cross]),
        ]
        nodes = [np.concatenate(x) for x in zip(*parts)]
        keep = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (nodes[4] <= nodes[5])
        stack.append((level - 1, tuple(x[keep] for x in nodes)))


def spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Indices of a forest of the links (i, j), light ones first, that joins whatever groups ``of`` rows the links
    join: every group picks its lightest link to another one, and groups so joined are one."""
    of = np.unique(of, return_inverse=True)[1]
    rank = np.empty(len(i), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(i))
    link = np.argsort(rank)
    chosen: list[np.ndarray] = []
    while True:
        a, b = of[i], of[j]
        live = a != b
        if not live.any():
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        best = np.full(int(of.max()) + 1, len(i))
        np.minimum.at(best, a[live], rank[live])
        np.minimum.at(best, b[live], rank[live])
        picked = link[best[best < len(i)]]
        chosen.append(picked)
        of = local_roots(len(best), of[i[picked]], of[j[picked]])[of]


def _blocks(rows: DataFrame, salt: int) -> DataFrame:
    """``rows(token, node, n, ...)`` with the block that each is in: token, x, y, side (0 everywhere). Each token has
    blocks of its own, so what one of them keeps apart meets in another."""
    x = F.pmod(F.xxhash64("node", "token", F.lit(salt)), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    return rows.select("token", x.alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), *[c for c in rows.columns if c != "token"])


def _block_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows(token, node, root, n, ...)`` once for each pair (x, y) of blocks of its token that its block, ``side``,
    is in. Blocks hold one kind of rows: of the token's largest group or of others, leading or not. Only kinds that can
    be linked meet: not two of the largest group, nor two that don't lead. Tokens of one group are left out."""
    lead = leads(similarity)
    per_root = rows.groupBy("token", "root").agg(F.count("*").alias("m"), F.count_if(lead).alias("leading"))
    by_size = F.struct("m", "root")
    largest = per_root.groupBy("token").agg(
        F.max_by("root", by_size).alias("big"),
        F.max("m").alias("of_big"),
        F.max_by("leading", by_size).alias("big_leading"),
        F.sum("leading").alias("leading"),
        F.count("*").alias("roots"),
    )
    # stored, so that the join splits the rows of a frequent token
    own = rows.join(stored(largest.filter("roots > 1 and leading > 0").drop("roots"), "dedup-largest"), "token")
    counted = [F.col("n") - F.col("of_big") - (F.col("leading") - F.col("big_leading")), F.col("leading") - F.col("big_leading"), F.col("big_leading"), F.col("of_big") - F.col("big_leading")]
    others, leading, big_leading, big = (F.ceil(x / BLOCK_ROWS).cast("int") for x in counted)
    zero, single, in_big = F.lit(0), F.col("n") <= BLOCK_ROWS, F.col("root") == F.col("big")

    def by_kind(*values: Column) -> Column:
        return F.when(~in_big & ~lead, values[0]).when(~in_big, values[1]).when(lead, values[2]).otherwise(values[3])

    # in this order of the kinds, the blocks that a kind meets are next to each other
    start = by_kind(zero, others, others + leading, others + leading + big_leading)
    width = F.greatest(by_kind(others, leading, big_leading, big), F.lit(1))
    first = by_kind(others, zero, zero, others)
    upto = by_kind(others + leading + big_leading, others + leading + big_leading + big, others + leading, others + leading)
    meets = F.when(single, F.array(zero)).when(upto > first, F.sequence(first, upto - 1))
    side = F.when(single, 0).otherwise(start + F.pmod(F.xxhash64("node", F.lit(99)), width)).cast("int")
    placed = own.withColumn("side", side).withColumn("other", F.explode(meets))
    pair = [F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")]
    return placed.select("token", *pair, "side", *[c for c in rows.columns if c != "token"])


def candidate_pairs(placed: DataFrame, similarity: float, thin: bool) -> DataFrame:
    """Of blocks by (token, x, y) the pairs (u, v) of nodes in different groups that may be similar; for a token of
    which more are left, because it was cut into blocks or ``thin`` kept a forest only, a row (null, null, token)."""
    columns = ["token", "x", "y", "node", "root", "side", "size", "pos", "n"] + [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH_WORDS)]
    rows = placed.select(*columns).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    out = arrow_schema(placed.sparkSession, "u long, v long, token long")
    spread = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, 3):
            group = _group_ids(held[:3])
            order = np.lexsort((held[9].view(np.uint64), group))
            token, x, y, node, root, side, size, pos, n = (c[order] for c in held[:9])
            group, sketch, size, pos = group[order], np.stack([c[order].view(np.uint64) for c in held[9:]], 1), size.astype(np.int64), pos.astype(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            rows_of = np.bincount(group)
            pairs_of = np.zeros(len(rows_of), np.int64)
            # groups of rows apart for each token
            of = np.unique(np.stack([group, root]), axis=1, return_inverse=True)[1].reshape(-1) if thin else root

            def forest(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
                """The pairs of blocks that aren't dense, and of those that are a forest only."""
                i, j = (np.concatenate(c) for c in zip(*found))
                much = (pairs_of > THIN_PAIRS * rows_of)[group[i]]
                a, b = i[much], j[much]
                weight = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) / np.maximum(1, (size[a] + size[b]) * spread)
                few = spanning(a, b, weight, of)
                return [(i[~much], j[~much]), (a[few], b[few])]

            held_pairs, most = 0, CHUNK_PAIRS
            for i, j in sketch_pairs(group, sketch, size, similarity):
                # if this is the first token that the sets share, so many are left to share at most
                after = np.minimum(size[i] - pos[i], size[j] - pos[j])
                least = np.ceil((size[i] + size[j]) * (similarity / (1 + similarity)) - 1e-6)
                ok = (root[i] != root[j]) & (after >= least) & ((side[i] != side[j]) | (x[i] == y[i]) | thin)
                found.append((i[ok], j[ok]))
                held_pairs += int(ok.sum())
                if thin:
                    pairs_of += np.bincount(group[i[ok]], minlength=len(rows_of))
                if held_pairs > most and thin:
                    # a forest of a forest and more pairs joins what all of them join; it is no larger than the rows
                    found = forest(found)
                    held_pairs = sum(len(i) for i, _ in found)
                    most = held_pairs + CHUNK_PAIRS
                elif held_pairs > most:
                    yield _links(node, found, out)
                    found, held_pairs = [], 0
            more = np.zeros(0, np.int64)
            if thin:
                more = token[(n > BLOCK_ROWS) | (pairs_of > THIN_PAIRS * rows_of)[group]]
                found = forest(found) if found else found
            if found:
                yield _links(node, found, out)
            more = np.unique(more)
            if len(more):
                none = pa.nulls(len(more), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(more)], schema=out)

    return map_batches(rows, run, "u long, v long, token long", rows=20_000)


def _links(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], out: pa.Schema) -> pa.RecordBatch:
    i, j = (np.concatenate(c) for c in zip(*found))
    both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64())], schema=out)


def similar_roots(shared: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """``shared_postings`` and ``texts``, which gives (node, text) of some nodes, → (node, root) of the groups that links
    of this Jaccard similarity reach.

    Every candidate is checked exactly before it counts. Of dense blocks a forest is checked first, so that
    groups of many near-copies grow together without all their pairs; in the last round all pairs of rows of the
    tokens still open that are in different groups meet, so no link between groups is left out.
    """
    links, roots, rooted = None, None, shared.withColumn("root", F.col("node"))
    for k in range(ROUNDS + 1):
        thin = k < ROUNDS
        found = stored(candidate_pairs(_blocks(rooted, k) if thin else _block_pairs(rooted, similarity), similarity, thin), "dedup-candidates")
        pairs = found.filter("token is null").select("u", "v").distinct()
        few = texts(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        checked = stored(similar_links(few, pairs, words, similarity), "dedup-links")
        links = checked if links is None else links.union(checked)
        still = found.filter("token is not null").select("token").distinct()
        if roots is None or not checked.isEmpty():
            roots = stored(connected_components(links), "dedup-roots")
        if not thin or still.isEmpty():
            break
        left = shared.join(still, "token", "left_semi")
        rooted = left.join(roots, "node", "left").select(*shared.columns, F.coalesce("root", "node").alias("root"))
    return roots


def similar_links(distinct: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the candidates those whose sets of shingles have this Jaccard similarity at least: an exact check."""
    texts = distinct.select("node", "text")
    pairs = candidates.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v"
    )

    def step(c: dict[str, list]) -> dict[str, list]:
        seen: dict[str, np.ndarray] = {}

        def hashes(text: str) -> np.ndarray:
            got = seen.get(text)
            if got is None:
                got = seen[text] = np.unique(shingle_hashes(text, words))
            return got

        out: dict[str, list] = {"u": [], "v": []}
        for u, v, a, b in zip(c["u"], c["v"], c["a"], c["b"]):
            x, y = hashes(a), hashes(b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both):
                out["u"].append(u)
                out["v"].append(v)
        return out

    return map_arrow(pairs.select("u", "v", "a", "b"), step, "u long, v long", rows=500)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id (nulls last).

    Texts with equal sets of shingles are copies; texts whose sets of shingles have the Jaccard similarity are
    linked; groups are what links reach. Candidates come from a join of prefixes (sets this similar share one of
    the first shingles of any common order) and, within a shingle, from the trie self-join over parity sketches;
    both lose no link, up to collisions of 64-bit hashes.

    Defined cases: a null text is the empty text; texts without words are copies of each other; a text with fewer
    words than a shingle is one shingle; repeated rows are copies, of which one stays; of equal smallest doc_ids
    either row stays; an empty table gives no rows. The columns of ``docs`` are returned, whatever their names.
    """
    schema = "row struct<file:bigint,index:bigint>, doc_id long, node long, size int, prefix array<long>, cold int, sketch array<long>"
    numbered = numbered_rows(docs)
    base = numbered.select("row", F.col("document.doc_id").cast("long").alias("doc_id"), "document.text")
    hot = hot_shingles(base.select("text"), words)

    def step(c: dict[str, list]) -> dict[str, list]:
        node, size, first, cold, sketch = [], [], [], [], []
        for text in c["text"]:
            hashes = np.unique(shingle_hashes(text, words))
            node.append(xxhash.xxh64_intdigest(hashes.tobytes(), 7))
            size.append(len(hashes))
            own, n = prefix(hashes, similarity, hot)
            first.append(own.view(np.int64))
            cold.append(n)
            sketch.append(parity_sketch(hashes))
        return {"row": c["row"], "doc_id": c["doc_id"], "node": np.array(node, np.uint64).view(np.int64), "size": size, "prefix": first, "cold": cold, "sketch": sketch}

    marked = stored(map_arrow(base, step, schema), "dedup-marks")
    distinct = marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "cold", "sketch")])
    shared = stored(shared_postings(distinct, similarity), "dedup-postings")

    def texts(nodes: DataFrame) -> DataFrame:
        rows = marked.select("node", "row").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
        return rows.join(numbered.select("row", "document.text"), "row").select("node", F.coalesce("text", F.lit("")).alias("text"))

    roots = similar_roots(shared, texts, words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = marked.groupBy("node").agg(F.min(order).alias("first"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(stay, "row", "left_semi").select("document.*")
