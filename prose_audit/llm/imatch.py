"""I-Match document fingerprints, in DataFrame functions only.

Terms within a band of inverse document frequency are kept, sorted and made distinct; hashes of several
randomised subsets of the lexicon are the fingerprint. Document frequencies are counted for each term (by its
64-bit hash) over all documents. The band is relative to the number of documents, so that the lexicon has
1 / MIN_SHARE times the distinct terms of a mean document at most, however large the corpus or its vocabulary;
it is stored as a table and goes to the tasks as the value of a scalar subquery, hashes by slot, so that neither the
plan nor the driver's program holds it. Subsets come in LEVELS levels of 8: those of a level are disjoint eighths of
the lexicon, thinned to half at each further level, so that texts of any length have subsets with a few of their terms.

Defined cases: a null text is the empty text; a text without terms in the band has a fingerprint of zeros,
which is like another such fingerprint (1.0) and unlike any other (0.0); equal texts have equal
fingerprints; null doc_ids come last in descending order, null or equal ones by the hash of their texts; very long texts
are read whole; an empty table gives no rows.
Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stored

#: The band: terms in MIN_DOCS documents and in MIN_SHARE of them at least, and in MAX_SHARE of them (or MIN_DOCS) at
#: most.
MIN_DOCS, MIN_SHARE, MAX_SHARE = 2, 0.0005, 0.08
#: Bits of a term's hash from which on they draw its subset.
DRAW_BITS = 18
#: Bytes of text of a range of doc_ids, about, as long as there are MAX_RANGES at most (larger ones are sorted with spill);
#: ends of ranges that are searched at once; bits of a text's hash that deal rows with null ids.
RANGE_BYTES, MAX_RANGES, END_RUN, NULL_BITS = 16 << 20, 1 << 16, 256, 16
#: Terms of the band in one slot, about.
SLOT_TERMS = 4
GROUPS, LEVELS = 8, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_hashes(text: Column) -> Column:
    """Sorted hashes of the distinct lower-cased terms of a text."""
    words = F.filter(F.split(F.lower(text), SPACE_CLASS), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def band(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term``, the hashes of the terms within the band, as a stored table. Counts cover all documents."""
    frequency = docs.select(F.explode(term_hashes(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    kept = frequency.filter((F.col("n") >= max(MIN_DOCS, MIN_SHARE * total)) & (F.col("n") <= max(MIN_DOCS, MAX_SHARE * total)))
    return stored(kept.select("term"), "band")


def by_slot(terms: DataFrame) -> tuple[Column, int]:
    """The hashes by their last bits, an array<array<long>> in one value, and the number of slots, a power of two.

    One task gathers them, which the bound of the band allows.
    """
    slots = 1 << (terms.count() // SLOT_TERMS).bit_length()
    held = terms.groupBy(F.col("term").bitwiseAND(slots - 1).alias("id")).agg(F.collect_list("term").alias("terms"))
    filled = terms.sparkSession.range(slots).join(held, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))))
    return filled.agg(F.transform(ordered, lambda s: s["terms"]).alias("slots")).scalar(), slots


def with_fingerprint(docs: DataFrame, text: Column, name: str, lexicon: tuple[Column, int]) -> DataFrame:
    """``docs`` with an array<int> of 64 values, by level and group: of a subset's terms in the text a hash from 1 to
    65,535, or 0 if there is none.

    The lexicon's column is used once, beside plain columns, so that Spark puts the two projections together and no
    row carries it; ``docs`` should end in a scan, a shuffle or a window rather than in computed columns.
    """
    held, slots = lexicon

    def in_band(held: Column, t: Column) -> Column:
        return F.array_contains(F.get(held, t.bitwiseAND(slots - 1).cast("int")), t)

    def subset(terms: Column, group: int) -> Column:
        own = F.filter(terms, lambda t: F.shiftright(t, DRAW_BITS).bitwiseAND(GROUPS - 1) == group)
        return let(own, lambda x: F.when(F.size(x) > 0, 1 + F.pmod(F.xxhash64(x), F.lit(65535))).otherwise(0).cast("int"))

    def level(k: int) -> Callable[[Column], Column]:
        def values(terms: Column) -> Column:
            own = F.array(*[subset(terms, g) for g in range(GROUPS)])
            if k + 1 == LEVELS:
                return own
            thinner = F.filter(terms, lambda t: F.shiftright(t, DRAW_BITS + 3 + k).bitwiseAND(1) == 0)
            return F.concat(own, let(thinner, level(k + 1)))

        return values

    known = let(F.col("lexicon"), lambda held: F.filter(term_hashes(text), lambda t: in_band(held, t)))
    return docs.select("*", held.alias("lexicon")).select(*docs.columns, let(known, level(0)).alias(name))


def as_text(values: Column) -> Column:
    """Four hex digits a value."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets that either text has terms in, the share with equal hashes; 1 if there is none."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    seen = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
    return F.when(seen > 0, same / seen).otherwise(F.lit(1.0))


def range_ends(docs: DataFrame, n: int) -> Column:
    """The largest doc_id of each of ``n`` ranges, an array<array<long>> of runs of END_RUN in one value.

    Spark samples and sorts the ids into ranges; the plan holds no value of them. One task gathers the ends, MAX_RANGES
    at most.
    """
    spread = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(n, "doc_id")
    ends = stored(spread.select("doc_id", F.spark_partition_id().alias("part")).groupBy("part").agg(F.max("doc_id").alias("end")), "ranges")
    runs = F.sequence(F.lit(0), F.floor((F.size("ends") - 1) / END_RUN).cast("int"))
    in_runs = F.transform(runs, lambda k: F.slice("ends", k * END_RUN + 1, END_RUN))
    gathered = ends.agg(F.sort_array(F.collect_set("end")).alias("ends"))
    return gathered.select(F.when(F.size("ends") > 0, in_runs).otherwise(F.array().cast("array<array<long>>"))).scalar()


def with_range(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``tie``, a hash of the text, and ``range``: how many ends are below the doc_id, or for a null one a
    negative number by ``tie``."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    below = lambda run: F.get(run, 0) < F.col("doc_id")

    def place(runs: Column) -> Column:
        last = F.size(F.filter(F.get(runs, F.size(runs) - 1), lambda end: end < F.col("doc_id")))
        return F.when(F.size(runs) > 0, (F.size(runs) - 1) * END_RUN + last).otherwise(0)

    ranged = let(F.filter(F.col("ends"), below), place)
    nulls = -1 - (1 << NULL_BITS - 1) - F.shiftright("tie", 64 - NULL_BITS).cast("int")
    dealt = docs.select("*", tie.alias("tie"), range_ends(docs, n).alias("ends"))
    return dealt.select(*docs.columns, "tie", F.when(F.col("doc_id").isNull(), nulls).otherwise(ranged).alias("range"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column> of the next document by descending doc_id; after the last comes the first.

    Documents are dealt into ranges of doc_id; the first rows of a range are also sent, as sentinels, to the
    range that comes before, so that a window within ranges sees every neighbour. The table of first rows has a row for
    each range, MAX_RANGES + 2**NULL_BITS at most, so it is broadcast.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)), MAX_RANGES)
    key = F.struct(F.bitwise_not("doc_id").alias("down"), "tie")
    dealt = with_range(docs, n)
    firsts = stored(dealt.groupBy("range").agg(F.min(key).alias("first")), "firsts")
    down = Window.orderBy(F.desc("range"))
    before = F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy()))  # the first range's is the last one
    firsts = firsts.select("range", "first", before.alias("before"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("sentinel"))
    other = F.struct(F.col("before").alias("range"), F.lit(1).alias("sentinel"))
    to = F.explode(F.when(key.eqNullSafe(F.col("first")), F.array(own, other)).otherwise(F.array(own)))
    joined = dealt.join(F.broadcast(firsts), "range").select(*docs.columns, "tie", to.alias("to"))
    rows = joined.select(*docs.columns, "tie", "to.range", "to.sentinel").repartition(max(n // 2, 1), "range")
    window = Window.partitionBy("range").orderBy("sentinel", F.col("doc_id").desc_nulls_last(), "tie", "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(window))
    return rows.filter("sentinel = 0").drop("range", "sentinel", "tie")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of edited texts, whose last third comes from the next document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = by_slot(band(own))
    both = with_next(with_fingerprint(own, F.coalesce("text", F.lit("")), "fp", lexicon), ["text", "fp"])
    text, n = F.coalesce("text", F.lit("")), F.coalesce(F.length("text"), F.lit(0))
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = with_fingerprint(both, edited, "edited_fp", lexicon)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
