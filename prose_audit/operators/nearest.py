"""The nearest authors of every document, by the sum of absolute differences of their style, without all pairs.

Pivots, a few authors, tell how far off everything is: the distance of a document and an author is at least the difference of
their distances to any pivot. Authors are range-sorted by their nearest pivot and the distance to it and packed into
blocks that know their least and largest distance to each pivot. A document goes to the block of the lowest bound
first; what it finds there bounds its k-th neighbour, and only blocks that can beat it get the document as well. A block
meets its documents in chunks of CHUNK rows, so neither a frequent block nor a large corpus is one group.

Defined cases: distances are over the words whose rate varies; equal distances are ordered by author, and with ``digits``
distances that are equal when rounded; a document without
words has rates of 0; a null or empty author text counts as a sample without words; repeated doc_ids are documents of their
own; without authors there are no rows; with fewer than k, all come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from .corpus import FUNCTION_WORDS, most_frequent, word_rates

#: Authors that serve as pivots; authors of a block; documents that meet a block at once.
PIVOTS, BLOCK, CHUNK = 8, 256, 4096
#: Blocks whose bounds go to every task: 16 numbers each.
MOST_BLOCKS = 100_000
PACKED = "block long, authors array<string>, vectors binary, near array<double>, far array<double>"


_stored = sinks.stored


def style_vectors(texts: DataFrame, key: str, scales: dict[str, float]) -> DataFrame:
    """``texts(key, text)``, keys different → key, v: rates of the words of ``scales``, each over its scale."""
    rates = word_rates(texts, key, list(scales))
    own = rates.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "rate"))).alias("r"))
    v = F.array(*[F.coalesce(F.try_element_at("r", F.lit(w)), F.lit(0.0)) / s for w, s in scales.items()])
    return texts.select(key).join(own, key, "left").select(key, v.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute differences of all rows of ``a`` and of ``b``, a row of ``b`` at a time."""
    return np.stack([np.abs(a - row).mean(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0))


def rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go up, as SQL rounds what isn't negative."""
    return d if digits is None else np.floor(d * 10.0**digits + 0.5) / 10.0**digits


def nearest_vectors(docs: DataFrame, authors: DataFrame, k: int, width: int, digits: int | None = None) -> DataFrame:
    """``docs(row, v)``, rows different, and ``authors(author_id, v)`` → row, author_id, delta, rank: the ``k`` nearest.
    With ``digits`` distances are rounded before they are ranked."""
    spark = docs.sparkSession
    slack = 1e-9 if digits is None else 1e-9 + 10.0**-digits  # what rounds to the k-th distance may be further off than it
    pivots = np.array([r.v for r in authors.orderBy(F.xxhash64("author_id"), "author_id").limit(PIVOTS).collect()], float).reshape(-1, width)

    def to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(matrix(b.column(1), width), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            columns = [b.column(0), b.column(1), pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["author_id", "v", "d", "cell", "own"])

    placed = authors.select(F.col("author_id").cast("string").alias("author_id"), "v").mapInArrow(to_pivots, "author_id string, v array<double>, d array<double>, cell int, own double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list[dict]) -> pa.RecordBatch:
            d = np.array([r["d"] for r in rows])
            out = {"block": (part << 32) + number, "authors": [r["author_id"] for r in rows], "vectors": np.array([r["v"] for r in rows], float).tobytes(), "near": d.min(axis=0).tolist(), "far": d.max(axis=0).tolist()}
            return pa.RecordBatch.from_pylist([out])

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == BLOCK or held[0]["cell"] != r["cell"]):
                    yield block(held)
                    held, number = [], number + 1
                held.append(r)
        if held:
            yield block(held)

    blocks = _stored(placed.repartitionByRange("cell", "own", "author_id").sortWithinPartitions("cell", "own", "author_id").mapInArrow(pack, PACKED), "author-blocks")
    bounds = blocks.select("block", "near", "far").orderBy("block").limit(MOST_BLOCKS + 1).collect()
    if len(bounds) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks of authors")
    if not bounds:
        return spark.createDataFrame([], "row long, author_id string, delta double, rank int")
    numbers, near, far = np.array([b.block for b in bounds]), np.array([b.near for b in bounds]), np.array([b.far for b in bounds])

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = distances(matrix(b.column(1), width), pivots)
                reach = None if first else np.array([np.inf if x is None else x for x in b.column(2).to_pylist()])
                rows, to = [], []
                for i, own in enumerate(d):
                    low = np.maximum(np.maximum(near - own, own - far), 0).max(axis=1)
                    start = int(np.lexsort((np.abs((near + far) / 2 - own).sum(axis=1), low))[0])
                    found = [start] if first else np.flatnonzero(low <= reach[i] + slack).tolist()
                    found = [x for x in found if first or x != start]
                    rows += [i] * len(found)
                    to += found
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64())), pa.array(numbers[to] if to else [], pa.int64())], names=["row", "v", "block"])

        return run

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "author_id": [], "delta": []}
        if asked.num_rows and block.num_rows:
            names = block["authors"][0].as_py()
            vectors = np.frombuffer(block["vectors"][0].as_py()).reshape(-1, width)
            for row, own in zip(asked["row"].to_pylist(), matrix(asked["v"].combine_chunks(), width)):
                d = rounded(np.abs(vectors - own).mean(axis=1), digits)
                for i in sorted(np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]), key=lambda i: (d[i], names[i]))[:k]:
                    out["row"].append(row)
                    out["author_id"].append(names[i])
                    out["delta"].append(float(d[i]))
        return pa.table([pa.array(out["row"], pa.int64()), pa.array(out["author_id"], pa.string()), pa.array(out["delta"], pa.float64())], names=["row", "author_id", "delta"])

    def met(asked: DataFrame) -> DataFrame:
        asked = _stored(asked, "asked")
        parts = asked.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))  # MOST_BLOCKS rows at most
        left = asked.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")
        right = blocks.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "authors", "vectors")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "row long, author_id string, delta double")

    schema = "row long, v array<double>, block long"
    found = _stored(met(docs.select("row", "v").mapInArrow(ask(True), schema)), "nearest")
    reach = found.groupBy("row").agg(F.when(F.count("*") >= k, F.max("delta")).alias("reach"))
    more = met(docs.select("row", "v").join(reach, "row", "left").mapInArrow(ask(False), schema))
    order = Window.partitionBy("row").orderBy("delta", "author_id")
    return found.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_authors(docs: DataFrame, baselines: DataFrame, k: int = 3, words: list[str] = FUNCTION_WORDS, n: int = 150, digits: int | None = None) -> DataFrame:
    """Burrows's Delta of every document from its ``k`` nearest authors: doc_id, author_id, delta, rank.

    Rates, deviations and authors' vectors are those of ``corpus.style_distance``; ``docs(doc_id, text)``,
    ``baselines(author_id, text)``. With ``digits`` deltas are rounded before they are ranked.
    """
    own = _stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    chosen = most_frequent(own, words, n)
    total = max(1, own.count())
    rate = word_rates(own, "row", chosen).groupBy("word").agg(F.sum("rate").alias("s"), F.sum(F.col("rate") ** 2).alias("q"))
    scales = {r.word: r.dev for r in rate.select("word", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / total - (F.col("s") / total) ** 2)).alias("dev")).filter("dev > 0").orderBy("word").collect()}
    if not scales:
        return own.sparkSession.createDataFrame([], "doc_id long, author_id string, delta double, rank int")
    samples = baselines.filter("author_id is not null").select(F.monotonically_increasing_id().alias("sample"), "author_id", "text")
    samples = _stored(samples, "samples")
    of_sample = style_vectors(samples.select("sample", "text"), "sample", scales).join(samples.select("sample", "author_id"), "sample")
    authors = of_sample.groupBy("author_id").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(scales))]).alias("v"))
    vectors = _stored(style_vectors(own.select("row", "text"), "row", scales), "vectors")
    found = nearest_vectors(vectors, _stored(authors, "authors"), k, len(scales), digits)
    return found.join(own.select("row", "doc_id"), "row").select("doc_id", "author_id", "delta", "rank")
