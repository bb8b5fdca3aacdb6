"""Flags brought to the sentence and the section that they lie in, and scores of sections.

Boundaries and flags are rows of one table, sorted once per document: a running count over the sentences numbers the
sections, and a flag takes the sentence and the section of the last boundary before it. That is a range (as-of) join
without a join: one shuffle, and what follows keeps its partitioning.

Defined cases: a null or empty text has no rows; rows with equal doc_ids are one document; a flag before the first
sentence of a document lies in none; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import java
from ..sources.rules import Rules
from .flags import review_paragraph
from .scoring import DIMENSIONS, PRESENCE, density_score, total
from .spans import sentence_spans

FLAGGED = ("d1", "d2", "d3", "d4")


def located(docs: DataFrame, rules: Rules, *, sep: str = "\n\n", window: int = 400, least: int = 0) -> DataFrame:
    """Sentences and flags of ``docs(doc_id, text)`` over ``least`` words, in order: doc_id, para_idx, start, end, side
    (0 a sentence, 1 a flag), n, head and signs of a sentence, type, dim and found of a flag, sentence, sentence_end, section.

    Sections are told by headings, or by ``window`` words where a document has none. A flag has the number of the last
    sentence that begins at or before it, and ``sentence_end``, null if that sentence is in an earlier paragraph.
    """
    text = F.coalesce("text", F.lit(""))
    paragraphs = docs.filter(X.word_count(text) > least).select("doc_id", F.posexplode(X.paragraphs(text, sep)).alias("para_idx", "p"))
    none = F.lit(None).cast("string")
    no_signs = F.array().cast("array<boolean>")

    def sentence(s: F.Column) -> F.Column:
        signs = F.array(*[s["text"].rlike(java(p)) for p in PRESENCE.values()])
        values = {"start": s["start"], "end": s["end"], "side": F.lit(0), "n": X.word_count(s["text"]), "head": X.is_heading(s["text"]).cast("int"), "signs": signs, "type": none, "dim": none, "found": none}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def flag(f: F.Column) -> F.Column:
        values = {"start": f["start"], "end": f["end"], "side": F.lit(1), "n": F.lit(0), "head": F.lit(0), "signs": no_signs, "type": f["type"], "dim": f["dim"], "found": f["found"]}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    both = F.concat(F.transform(sentence_spans(F.col("p")), sentence), F.transform(review_paragraph(F.col("p"), rules), flag))
    rows = paragraphs.select("doc_id", "para_idx", F.explode(both).alias("x")).select("doc_id", "para_idx", "x.*")
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("para_idx", "start", "side", "end", "type", "found")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_sentence = F.col("side") == 0
    rows = rows.withColumns({
        "sentence": (F.sum(is_sentence.cast("int")).over(so_far) - 1).cast("int"), "by_head": F.sum("head").over(so_far),
        "heads": F.sum("head").over(whole.orderBy("para_idx", "start", "side", "end", "type", "found").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "before": F.sum("n").over(so_far) - F.col("n"),
    })
    own = F.when(is_sentence, F.when(F.col("heads") > 0, F.col("by_head")).otherwise(F.floor(F.col("before") / window)).cast("int"))
    last = F.last(F.when(is_sentence, F.struct("para_idx", "end")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"section": F.last(own, ignorenulls=True).over(so_far), "last": last})
    end = F.when(F.col("last.para_idx") == F.col("para_idx"), F.col("last.end"))
    return rows.withColumn("sentence_end", end).drop("by_head", "heads", "before", "last")


def flags_in_sentences(docs: DataFrame, rules: Rules, *, sep: str = "\n\n") -> DataFrame:
    """doc_id, para_idx, start, end, type, found, sentence (its number in the document) and ``inside``: whether the
    flag ends with that sentence or before."""
    rows = located(docs, rules, sep=sep).filter("side = 1")
    inside = F.coalesce(F.col("end") <= F.col("sentence_end"), F.lit(False))
    return rows.select("doc_id", "para_idx", "start", "end", "type", "found", "sentence", inside.alias("inside"))


def section_scores(docs: DataFrame, rules: Rules, *, sep: str = "\n\n", window: int = 400, least: int = 1200, most: float = 4.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores of the sections of documents over ``least`` words: doc_id, section, n_words, n_sentences, n_flags, d1 to
    d5, total, doc_mean (of its sections) and deviates: whether the section is more than ``most`` points off it."""
    rows = located(docs, rules, sep=sep, window=window, least=least)
    signs = [F.coalesce(F.max(F.get("signs", F.lit(i)).cast("int")), F.lit(0)).alias(f"s{i}") for i in range(len(PRESENCE))]
    counts = [F.count_if(F.col("dim") == k).alias(f"n_{k}") for k in FLAGGED]
    per = rows.groupBy("doc_id", "section").agg(F.sum("n").alias("n_words"), F.count_if(F.col("side") == 0).alias("n_sentences"), F.count_if(F.col("side") == 1).alias("n_flags"), *counts, *signs)
    dims = [density_score(F.col(f"n_{k}"), F.col("n_words")).alias(k) for k in FLAGGED]
    presence = (F.lit(4.0) - sum((F.col(f"s{i}") for i in range(len(PRESENCE))), F.lit(0))).alias("d5")
    w = [float((weights or {}).get(k, d)) for k, _, d in DIMENSIONS]
    scored = per.select("doc_id", "section", "n_words", "n_sentences", "n_flags", *dims, presence)
    scored = scored.withColumn("total", total([F.col(k) for k, _, _ in DIMENSIONS], w))
    mean = F.avg("total").over(Window.partitionBy("doc_id"))
    return scored.withColumn("doc_mean", mean).withColumn("deviates", F.abs(F.col("total") - F.col("doc_mean")) > most)
