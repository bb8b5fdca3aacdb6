"""Stock phrases found in a corpus: word sequences that many documents use and labelled good ones don't.

Counts of all sequences would be as large as the corpus. A count-min sketch takes their place: DEPTH rows of cells, into
which every task adds up what it reads, so sketches of tasks (or of days) merge by adding cells. Its estimates are never too
low, so sequences with too low an estimate go, in the row of their document. What is left are candidates, and only these are
shuffled and counted exactly. The sketch has WIDTH cells a row for each sequence that could be frequent, which depends on
the mean document and on the least share, not on the size of the corpus; so does the number of candidates.

Defined cases: a sequence counts once a document; a null or empty text has none; rows with equal doc_ids are documents of
their own; without good documents nothing is compared and all frequent sequences come out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WORDS = "[a-z]+(?:'[a-z]+)*"
#: Rows of the sketch; cells in a row for each sequence that can be frequent; most cells in a row.
DEPTH, WIDTH, MOST_CELLS = 3, 8, 1 << 22


def sequences(text: Column, n: int) -> Column:
    """array<string> of the distinct sequences of ``n`` words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    places = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(X.let(words, lambda w: F.transform(places(w), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))


def cell(sequence: Column, row: int, cells: int) -> Column:
    """The cell of a sequence in a row of the sketch, counted through all rows."""
    return (F.pmod(F.xxhash64(sequence, F.lit(row)), F.lit(cells)) + row * cells).cast("int")


def sketch(docs: DataFrame, n: int, cells: int) -> DataFrame:
    """cell, n: in how many documents of ``docs(text)`` the sequences of a cell are. Sketches merge by adding n."""
    own = F.transform(sequences(F.col("text"), n), lambda s: F.array(*[cell(s, r, cells) for r in range(DEPTH)]))
    return docs.select(F.explode(F.flatten(own)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of several."""
    out = sketches[0]
    for other in sketches[1:]:
        out = out.unionByName(other)
    return out.groupBy("cell").agg(F.sum("n").alias("n"))


def as_value(counts: DataFrame, cells: int) -> Column:
    """The sketch as one array in cell order, which reaches the tasks as a scalar subquery's value. One task gathers it,
    DEPTH * MOST_CELLS numbers at most."""
    every = counts.sparkSession.range(DEPTH * cells).select(F.col("id").cast("int").alias("cell"))
    filled = every.join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("int").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("cell", "n")))
    return filled.agg(F.transform(ordered, lambda x: x["n"]).alias("sketch")).scalar()


def mine_phrases(docs: DataFrame, good: Column, *, n: int = 3, least_share: float = 0.01, least_docs: int = 2, ratio: float = 2.0) -> DataFrame:
    """``docs(text)`` → phrase, docs, rate, good_docs, good_rate, of the sequences of ``n`` words that at least
    ``least_share`` of the documents where ``good`` isn't true have (and ``least_docs`` of them), ``ratio`` times as often as the
    good ones at least."""
    own = docs.select("text", F.coalesce(good, F.lit(False)).alias("good"))
    size = F.greatest(F.lit(0), F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS)) - (n - 1))
    totals = own.agg(F.count_if(~F.col("good")).alias("studied"), F.count_if("good").alias("good"), F.coalesce(F.sum(F.when(~F.col("good"), size)), F.lit(0)).alias("places")).first()
    least = max(least_docs, least_share * totals.studied)
    frequent = max(1, totals.places / least)  # sequences that can be in ``least`` documents, at most
    cells = min(MOST_CELLS, 1 << int(WIDTH * frequent).bit_length())
    known = as_value(sketch(own.filter(~F.col("good")), n, cells), cells)

    def may_be(s: Column, held: Column) -> Column:
        return F.least(*[F.get(held, cell(s, r, cells)) for r in range(DEPTH)]) >= least

    with_sketch = own.select("*", known.alias("held"))
    candidates = with_sketch.select("good", F.explode(X.let(F.col("held"), lambda held: F.filter(sequences(F.col("text"), n), lambda s: may_be(s, held)))).alias("phrase"))
    counts = candidates.groupBy("phrase").agg(F.count_if(~F.col("good")).alias("docs"), F.count_if("good").alias("good_docs"))
    rated = counts.select("phrase", "docs", (F.col("docs") / F.lit(max(1, totals.studied))).alias("rate"), "good_docs", (F.col("good_docs") / F.lit(max(1, totals.good))).alias("good_rate"))
    return rated.filter((F.col("docs") >= least) & (F.col("rate") >= ratio * F.col("good_rate")))
