"""Review scores kept up to date: only paragraphs that changed are looked at again.

``paragraph_state`` holds what each paragraph adds to its document: its content hash, words, flags by dimension and
signs of an author. Documents are sums of that. After edits or dismissals, the paragraphs whose hash is another, which
are new or have newly dismissed flags, are scored; the sums of their documents are patched by the differences.

Defined cases: a null paragraph is the empty one; a paragraph that is gone is taken off its document's sums, and a
document without paragraphs goes; pairs of doc_id and para_idx are to be unique and not null; flags of whole documents
(stacked connectives, headings) are no part of these scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import sinks
from ..sources.rules import Rules
from .flags import review_paragraph
from .scoring import DIMENSIONS, PRESENCE, density_score, presence_pattern, total, verdict

KEY = ["doc_id", "para_idx"]
FLAG_KEY = [*KEY, "type", "found", "start"]
SUMS = ["n_words", "d1", "d2", "d3", "d4", *[f"s{i}" for i in range(len(PRESENCE))]]


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def paragraph_state(paragraphs: DataFrame, rules: Rules, dismissed: DataFrame | None = None) -> DataFrame:
    """``paragraphs(doc_id, para_idx, output)`` → doc_id, para_idx, hash, n_words, d1 to d4 (flags, without the dismissed
    ones), s0 to s3 (1 where the sign is there).

    ``dismissed(doc_id, para_idx, type, found, start)`` are gathered by paragraph, a person's work and so few."""
    text = F.coalesce("output", F.lit(""))
    rows = paragraphs.select(*KEY, text.alias("t"))
    none = F.array().cast("array<struct<type:string,found:string,start:int>>")
    if dismissed is not None:
        gone = dismissed.groupBy(*KEY).agg(F.collect_set(F.struct("type", "found", F.col("start").cast("int").alias("start"))).alias("gone"))
        rows = rows.join(gone, KEY, "left").withColumn("gone", F.coalesce("gone", none))
    rows = rows.withColumn("flags", review_paragraph(F.col("t"), rules, excerpts=False))
    left = F.col("flags") if dismissed is None else F.filter("flags", lambda f: ~F.array_contains(F.col("gone"), F.struct(f["type"].alias("type"), f["found"].alias("found"), f["start"].alias("start"))))
    rows = rows.withColumn("left", left)

    def number(dim: str) -> Column:
        return F.size(F.filter("left", lambda f: f["dim"] == dim)).cast("long").alias(dim)

    counts = [number(k) for k in ("d1", "d2", "d3", "d4")]
    signs = [F.col("t").rlike(presence_pattern(k)).cast("long").alias(f"s{i}") for i, k in enumerate(PRESENCE)]
    return rows.select(*KEY, content_hash(F.col("t")).alias("hash"), X.word_count(F.col("t")).cast("long").alias("n_words"), *counts, *signs)


def document_sums(state: DataFrame) -> DataFrame:
    """doc_id, paragraphs and the sums of a state."""
    return state.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), *[F.sum(c).alias(c) for c in SUMS])


def changed_paragraphs(state: DataFrame, paragraphs: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """The paragraphs to score again: new ones, those of another hash and those with newly dismissed flags."""
    known = paragraphs.join(state.select(*KEY, "hash"), KEY, "left")
    changed = F.coalesce(content_hash(F.col("output")) != F.col("hash"), F.lit(True))
    if dismissed is None:
        return known.filter(changed).drop("hash")
    marked = known.join(dismissed.select(*KEY, F.lit(True).alias("dismissed")).distinct(), KEY, "left")
    return marked.filter(changed | F.col("dismissed")).drop("hash", "dismissed")


def patched_sums(sums: DataFrame, state: DataFrame, paragraphs: DataFrame, rules: Rules, dismissed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums and rows of the state after a change of paragraphs or dismissals, as ``document_sums`` and
    ``paragraph_state`` of everything would give them. Dismissals and what is scored again are stored, as both are read
    several times. Only changed paragraphs reach the rules, and only documents with
    a change are patched."""
    dismissed = None if dismissed is None else sinks.stored(dismissed, "dismissed")
    fresh = sinks.stored(paragraph_state(changed_paragraphs(state, paragraphs, dismissed).select(*KEY, "output"), rules, dismissed), "fresh")
    gone = state.join(paragraphs.select(*KEY), KEY, "left_anti")
    replaced = state.join(fresh.select(*KEY), KEY, "left_semi")
    minus = replaced.unionByName(gone).select("doc_id", F.lit(-1).alias("paragraphs"), *[(-F.col(c)).alias(c) for c in SUMS])
    plus = fresh.select("doc_id", F.lit(1).alias("paragraphs"), *SUMS)
    delta = plus.unionByName(minus).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("paragraphs", *SUMS)])
    both = sums.unionByName(delta.withColumn("paragraphs", F.col("paragraphs").cast("long")))
    patched = both.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("paragraphs", *SUMS)]).filter("paragraphs > 0")
    kept = state.join(fresh.select(*KEY), KEY, "left_anti").join(paragraphs.select(*KEY), KEY, "left_semi")
    return patched, kept.unionByName(fresh)


def scored(sums: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, d1 to d5, total and verdict of documents' sums."""
    dims = {k: density_score(F.col(k), F.col("n_words")) for k in ("d1", "d2", "d3", "d4")}
    presence = F.lit(4.0) - sum((F.least(F.lit(1), F.col(f"s{i}")) for i in range(len(PRESENCE))), F.lit(0))
    w = [float((weights or {}).get(k, d)) for k, _, d in DIMENSIONS]
    out = sums.select("doc_id", "n_words", *[v.alias(k) for k, v in dims.items()], presence.alias("d5"))
    return out.withColumn("total", total([F.col(k) for k, _, _ in DIMENSIONS], w)).withColumn("verdict", verdict(F.col("total")))
