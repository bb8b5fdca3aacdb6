"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

Every source has a weight and a schedule of how its weight runs over training time from 0 to 1: a straight
line with mean 1. The integral of the schedule up to a time is the share of the source's target that is
taken by then. The documents of a source, in a random but fixed order and as many times over as the target
needs, take their places in that cumulative demand; inverting the integral gives each take its training
position. Documents are range-sorted by the position of their first take.

Running sums within a source are taken in two steps, over 4,096 hash ranges and inside them, so a source
with a third of all rows is no single group, and rows without doc_ids are spread by their sizes. One row for
each source is ordered in one task: 10,000 sources, say, are under 1 MB.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; documents of
size 0 are taken 0 words and have no position; repeated rows are documents of their own; an empty table
gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered_rows, stored

#: Weights by rank of the source, repeating; words to take as a share of all; most takes of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Schedules by rank, repeating: relative weight at the beginning; at the end it is 2 minus that.
BEGIN = (0.5, 1.0, 1.5)


def of_rank(values: tuple, rank: Column) -> Column:
    """The rank's value (ranks begin at 0)."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``sized(source, size)`` → source, rank, source_size, target.

    Sources at their limit are those with the smallest limit per weight: in that order, the first level of
    words per weight that fits the source it is computed at fits all others.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", of_rank(WEIGHTS, F.col("rank")).cast("double")).withColumn("limit", F.lit(float(MOST)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    leveled = weighted.withColumn("level", (total - full) / open_weight)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))
    level = F.max(fits).over(everything)
    target = F.coalesce(F.least("limit", level * F.col("weight")), F.col("limit"))
    return leveled.select("source", "rank", "source_size", target.alias("target"))


def position(share: Column, begin: Column) -> Column:
    """The time by which this share of a source's target is taken: the inverse of the schedule's integral
    ``begin * t + (1 - begin) * t * t``."""
    bend = 1 - begin
    root = (F.sqrt(begin * begin + 4 * bend * share) - begin) / (2 * bend)
    return F.when(bend == 0, share).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def demand(docs: DataFrame) -> DataFrame:
    """``docs(row, doc_id, text, source)`` with where each row lies in its source's demand: row, doc_id, rank,
    size, source_size, target, before (words of the source's rows that come first), whole (takes of every
    row), rest (words of the target beyond those), extra (of these the row's), begin (of the schedule)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    targets = source_targets(sized)
    order = F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    keyed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("row", "doc_id", "size", "rank", "source_size", "target", order.alias("key"))
    keyed = keyed.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    ranges = keyed.groupBy("rank", "range").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("rank", "range", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["rank", "range"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    rows = placed.withColumn("before", F.col("base") + F.col("inner")).withColumn("whole", whole).withColumn("rest", rest)
    return rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).withColumn("begin", of_rank(BEGIN, F.col("rank")))


def mix(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` → doc_id, size, source_size, target, taken, takes, position.

    ``taken`` is the words taken in all, whole takes and a part of one document at the end of a source's
    demand; ``takes`` is the number of takes begun, ``position`` the training position of the first.
    """
    rows = demand(docs.select(F.lit(0).alias("row"), "doc_id", "text", "source")).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    takes = F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") > 0).cast("long")).otherwise(0)
    first = F.when(F.col("taken") > 0, position(F.col("before") / F.col("target"), F.col("begin")))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", takes.alias("takes"), first.alias("position"))
    order = F.col("position").asc_nulls_last()
    return out.repartitionByRange(order, "doc_id").sortWithinPartitions(order, "doc_id")


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, once for each take and in the order of training positions.

    Rows are whole: the take at the end of a source's demand comes up if half of it or more is within.
    """
    numbered = numbered_rows(docs)
    rows = demand(numbered.select("row", "document.doc_id", "document.text", "document.source"))
    copies = F.col("whole") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    take = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    share = ((F.col("take") - 1) * F.col("source_size") + F.col("before")) / F.col("target")
    # the rounding at the end may go over the demand by half a document
    placed = rows.withColumn("copies", copies).filter("copies > 0 and size > 0").withColumn("take", take)
    placed = placed.withColumn("position", position(F.least(F.lit(1.0), share), F.col("begin"))).select("row", "take", "position")
    order = F.col("position").asc_nulls_last()
    return numbered.join(placed, "row").repartitionByRange(order, "row").sortWithinPartitions(order, "row").select("document.*")


#: The same as SQL over the table ``documents``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals),
weighted AS (SELECT *, CAST([5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS lim FROM ranked),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, rank, source_size, coalesce(least(lim, max(CASE WHEN level <= lim / weight THEN level END) OVER () * weight), lim) AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || CAST(s.size AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
    CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
amounts AS (
  SELECT *, greatest(0, least(size, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before)) AS extra,
    [0.5, 1.0, 1.5][CAST(rank % 3 + 1 AS INT)]::DOUBLE AS b FROM placed)
SELECT doc_id, size, source_size, target, whole * size + extra AS taken,
  CASE WHEN size > 0 THEN whole + CASE WHEN extra > 0 THEN 1 ELSE 0 END ELSE 0 END AS takes,
  CASE WHEN whole * size + extra > 0 THEN CASE WHEN b = 1 THEN before / target
    ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sqrt(b * b + 4 * (1 - b) * (before / target)) - b) / (2 * (1 - b)))) END END AS position
FROM amounts
"""
