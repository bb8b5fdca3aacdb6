"""Hard negatives by BOND, a branch-and-bound scan of vertically stored vectors.

Rows are range-sorted by label and packed into blocks of at most MOST_ROWS, stored by dimension, with the least and the
largest value of each dimension; anchors are packed into groups likewise. A task takes a block and a group. For each
anchor it reads the dimensions in the order of the anchor's magnitudes, a few at a time, and adds up partial scores.
What the dimensions left can still contribute is bounded by the block's extremes, so the bitmap of candidates shrinks
until the exact scores of the few that are left are known. Two scans follow each other: the first finds each anchor's
positives, in the blocks that hold its label; their scores give windows, for which the second finds the negatives.

The anchors are a query set against all rows, in blocks; each side of a task has a fixed size, and nothing is
broadcast or collected. What blocks find is merged by ranks within an anchor or a positive.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a shorter
vector counts as filled up with zeros; a null vec_id is no anchor and comes last in ties; rows with equal vec_ids are rows of their own,
and each is an anchor of its own; an anchor without positives, and a positive without negatives in its window, give no
rows; an empty table gives no rows; components and scores beyond a long saturate. Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, placed, stored

#: Rows of a block or anchors of a group at most, and of their values (but 64 rows at least).
MOST_ROWS, MOST_VALUES = 4096, 1 << 18
#: Dimensions that are read before candidates are looked at again, in turn; the last is repeated.
STEPS = (16, 8)
#: Stands for a null vec_id.
NO_ID = (1 << 63) - 1
PACKED = "block long, ids binary, rows binary, labels binary, values binary, wide boolean, dims int"


def usable(rows: DataFrame, anchor: Column) -> DataFrame:
    """``rows(vec_id, embedding, label)`` → id, label, values, asked of the rows that take part: floor(256 * component),
    and whether the row is an anchor."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    values = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), values.alias("values"), (anchor & F.col("vec_id").isNotNull()).alias("asked"))


def packed(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """``rows(place, id, label, values, row)`` in blocks of ``size``, by place, values by dimension."""
    out = arrow_schema(rows.sparkSession, PACKED)

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["place"].to_numpy(), kind="stable")
        flat = table["values"].combine_chunks()
        lengths, matrix = np.diff(flat.offsets.to_numpy()), np.zeros((len(order), dims), np.int64)
        matrix[np.arange(dims) < lengths[:, None]] = flat.flatten().to_numpy()
        by_dimension = np.ascontiguousarray(matrix[order].T)
        wide = bool(by_dimension.size and np.abs(by_dimension.astype(float)).max() >= 1 << 15)
        ids, numbers, labels = (table[c].to_numpy()[order].astype("<i8").tobytes() for c in ("id", "row", "label"))
        row = {"block": int(table["place"][0].as_py()) // size, "ids": ids, "rows": numbers, "labels": labels, "values": by_dimension.astype("<i8" if wide else "<i2").tobytes(), "wide": wide, "dims": dims}
        return pa.Table.from_pylist([row], schema=out)

    return rows.withColumn("block", F.floor(F.col("place") / size)).groupBy("block").applyInArrow(pack, PACKED)


class Vectors:
    """A block or a group as arrays: ids, rows, labels, values[dimension, row]."""

    def __init__(self, row: dict, side: str) -> None:
        self.ids, self.rows, self.labels = (np.frombuffer(row[f"{side}_{c}"], "<i8") for c in ("ids", "rows", "labels"))
        self.values = np.frombuffer(row[f"{side}_values"], "<i8" if row[f"{side}_wide"] else "<i2").reshape(row[f"{side}_dims"], -1)

    def most(self) -> int:
        return int(np.abs(self.values.astype(float)).max(initial=0))


class Scan:
    """A block read by dimension for one anchor after another."""

    def __init__(self, block: Vectors, group: Vectors) -> None:
        exact = len(block.values) * (block.most() + 1) * (group.most() + 1) < 1 << 53  # sums of doubles are whole numbers
        self.kind = float if exact else object
        self.block, self.values = block, block.values.astype(self.kind)
        self.least, self.largest = self.values.min(axis=1), self.values.max(axis=1)

    def survivors(self, anchor: np.ndarray, candidates: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``keep`` leaves to the end, and their scores. It gets the bounds of the scores of those left so
        far, from below and from above, and says which can still matter."""
        anchor = anchor.astype(self.kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor * self.least, anchor * self.largest
        low, high = (np.concatenate([x[order][::-1].cumsum()[::-1], [0]]) for x in (np.minimum(a, b), np.maximum(a, b)))
        scores, at, step = np.zeros(len(candidates), self.kind), 0, 0
        while at < len(order) and len(candidates):
            dims = order[at : at + STEPS[min(step, len(STEPS) - 1)]]
            part = self.values[dims] if len(candidates) == self.values.shape[1] else self.values[np.ix_(dims, candidates)]
            scores = scores + anchor[dims] @ part
            at, step = at + len(dims), step + 1
            stays = keep(scores + low[at], scores + high[at])
            if not stays.all():
                candidates, scores = candidates[stays], scores[stays]
        return candidates, scores

    def first(self, candidates: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """The first ``n``, by score and id: score, id, row."""
        if len(scores) > n and self.kind is float:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            candidates, scores = candidates[scores >= least], scores[scores >= least]
        ids, rows = self.block.ids[candidates], self.block.rows[candidates]
        found = sorted(zip((-int(s) for s in scores), ids.tolist(), rows.tolist()))[:n]
        return [(-s, i, r) for s, i, r in found]


def largest(values: np.ndarray, n: int) -> float:
    """The n-th largest value, or less than any if there are fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def positives_of(scan: Scan, anchors: Vectors, n: int) -> Iterator[tuple]:
    """For each anchor the first ``n`` rows of its label in the block: row of the anchor, 0, score, id, row."""
    labels = scan.block.labels  # in order
    for k in range(len(anchors.ids)):
        start, end = np.searchsorted(labels, anchors.labels[k], "left"), np.searchsorted(labels, anchors.labels[k], "right")
        own = np.arange(start, end)
        own = own[scan.block.rows[own] != anchors.rows[k]]
        if len(own):
            left, scores = scan.survivors(anchors.values[:, k], own, lambda low, high: high >= largest(low, n))
            for found in scan.first(left, scores, n):
                yield (int(anchors.rows[k]), 0, *found)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores that are ``low`` to ``high`` per cent of a score, as whole numbers."""
    return -((-low * score) // 100), (high * score) // 100


def negatives_of(scan: Scan, anchors: Vectors, wanted: dict[int, list[int]], n: int, share: tuple[int, int]) -> Iterator[tuple]:
    """For each anchor's positives, by their number, the first ``n`` rows of other labels with scores in the window."""
    for k in range(len(anchors.ids)):
        windows = [(i, *window(p, *share)) for i, p in enumerate(wanted.get(int(anchors.rows[k]), ()))]
        windows = [w for w in windows if w[1] <= w[2]]
        others = np.flatnonzero(scan.block.labels != anchors.labels[k])
        if not windows or not len(others):
            continue
        top = max(high for _, _, high in windows)

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            inside = min(max(a, largest(low[(low >= a) & (high <= b)], n)) for _, a, b in windows)
            return (high >= inside) & (low <= top)

        left, scores = scan.survivors(anchors.values[:, k], others, keep)
        for i, a, b in windows:
            fits = (scores >= a) & (scores <= b)
            for found in scan.first(left[fits], scores[fits], n):
                yield (int(anchors.rows[k]), i, *found)


def scanned(pairs: DataFrame, blocks: DataFrame, groups: DataFrame, n: int, share: tuple[int, int] | None) -> DataFrame:
    """What each pair of ``pairs(block, group)`` finds: anchor, number, score, id, row. With a ``share``, ``groups`` have
    ``wanted``, the scores of the positives."""
    spark = pairs.sparkSession
    schema = "anchor long, number int, score long, id long, row long"
    out = arrow_schema(spark, schema)
    parts = max(4 * pairs.count(), 1)
    left = blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in blocks.columns if c != "block"]).join(pairs, "block").repartition(parts, "block", "group")
    right = groups.select(F.col("block").alias("group"), *[F.col(c).alias(f"g_{c}") for c in groups.columns if c != "block"]).join(pairs, "group").repartition(parts, "block", "group")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, anchors = Vectors(row, "b"), Vectors(row, "g")
                work = Scan(block, anchors)
                if share:
                    wanted = {w["row"]: w["scores"] for w in row["g_wanted"]}
                    found = list(negatives_of(work, anchors, wanted, n, share))
                else:
                    found = list(positives_of(work, anchors, n))
                columns = list(zip(*found)) or [()] * 5
                limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
                yield pa.RecordBatch.from_arrays([pa.array(map(limit, c) if f.name == "score" else c, f.type) for c, f in zip(columns, out)], schema=out)

    return left.join(right, ["block", "group"]).mapInArrow(scan, schema)


def first_of(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """``rows(vec_id, embedding, label)`` → anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchor``, a condition on ``vec_id``, is true. Their positives are the first
    ``positives`` other rows of the same label, by score; for each, the first ``negatives`` rows of another label with
    ``share`` per cent of its score come out.
    """
    own = usable(rows, anchor).select(F.lit("").alias("tree"), "*")
    ranked = stored(placed(own, ["label", "id"]).select("place", "id", "label", "values", "asked", F.col("place").alias("row")), "vectors")
    total, dims = ranked.agg(F.count("*"), F.coalesce(F.max(F.size("values")), F.lit(0))).first()
    size = min(MOST_ROWS, max(64, MOST_VALUES // max(dims, 1)))
    chosen = placed(ranked.filter("asked").select(F.lit("").alias("tree"), "id", "label", "values", "row"), ["label", "row"]).drop("tree", "nodes")
    blocks = stored(packed(ranked, size, dims), "vector-blocks")
    groups = stored(packed(chosen, size, dims), "anchor-groups")
    in_block = ranked.select(F.floor(F.col("place") / size).alias("block"), "label").distinct()
    in_group = chosen.select(F.floor(F.col("place") / size).alias("group"), "label").distinct()
    pairs = stored(in_block.join(in_group, "label").select("block", "group").distinct(), "pairs")
    best = stored(first_of(scanned(pairs, blocks, groups, positives, None), ["anchor"], positives), "positives")
    scores = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    of_group = chosen.select(F.floor(F.col("place") / size).alias("block"), F.col("row").alias("anchor")).join(scores, "anchor")
    wanted = of_group.groupBy("block").agg(F.collect_list(F.struct(F.col("anchor").alias("row"), "scores")).alias("wanted"))  # ``size`` at most
    n_blocks, n_groups = -(-total // size), max(1, groups.count())
    everything = rows.sparkSession.range(n_blocks * n_groups).select(F.floor(F.col("id") / n_groups).alias("block"), (F.col("id") % n_groups).alias("group"))
    found = first_of(scanned(everything, blocks, groups.join(wanted, "block"), negatives, share), ["anchor", "number"], negatives)
    anchors = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs_of = best.select("anchor", (F.col("rank") - 1).alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors, "anchor")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = found.select("anchor", "number", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs_of, ["anchor", "number"])
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


#: The same over the table ``embeddings``, as SQL.
MINE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
