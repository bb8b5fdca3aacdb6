"""Review: edits that people accepted are replayed on the paragraphs, in order, from the base text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.rules import Rules
from .scoring import score_in_row

EDIT = "struct<seq:int,from:string,to:string,nth:int>"
REPLAYED = T.StructType([T.StructField("text", T.StringType()), T.StructField("missing", T.ArrayType(T.IntegerType()))])


def nth_index(text: str, what: str, nth: int) -> int:
    """Where the nth occurrence (from 0) of ``what`` begins, or -1."""
    at = -1
    for _ in range(nth + 1):
        at = text.find(what, at + 1)
        if at < 0 or not what:
            return -1
    return at


def replay(base: str, edits: list[dict]) -> tuple[str, list[int]]:
    """The text after all edits, and the seq of those whose words weren't there."""
    text, missing = base, []
    for e in edits:
        at = nth_index(text, e["from"] or "", e["nth"] or 0)
        if at < 0:
            missing.append(e["seq"])
        else:
            text = tidy_deletion(text, at, e["from"]) if e["to"] == "" else text[:at] + (e["to"] or "") + text[at + len(e["from"]) :]
    return text, missing


def tidy_deletion(text: str, at: int, what: str) -> str:
    """The text without ``what``: no double space, none before punctuation, a capital where a sentence begins."""
    left, right = text[:at], text[at + len(what) :]
    if not left or left.endswith((" ", "\n")):
        right = right.lstrip(" ")
    if re.match("[.,;:!?]", right):
        left = left.rstrip(" ")
    if not right.strip():
        left = left.rstrip(" ")
    if re.search(r"(?:\A|[.!?]\s+|\n)\Z", left):
        right = right[:1].upper() + right[1:]
    return left + right


def replay_edits(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """``paragraphs(doc_id, para_idx, output)`` and ``edits(doc_id, para_idx, seq, from, to, nth)`` → doc_id, para_idx,
    output, n_edits, missing. Edits are gathered per paragraph first: they are a person's work, so few."""
    own = edits.groupBy("doc_id", "para_idx").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(t) for c, t in (("seq", "int"), ("from", "string"), ("to", "string"), ("nth", "int"))]))).cast(f"array<{EDIT}>").alias("edits"))

    @F.pandas_udf(REPLAYED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, todo in batches:
            got = [replay(t or "", [] if e is None else list(e)) for t, e in zip(text, todo)]
            yield pd.DataFrame({"text": [g[0] for g in got], "missing": [g[1] for g in got]})

    joined = paragraphs.select("doc_id", "para_idx", "output").join(own, ["doc_id", "para_idx"], "left")
    # only texts with edits go to the helper
    done = joined.withColumn("r", run(F.when(F.col("edits").isNotNull(), F.col("output")), F.col("edits")))
    has = F.col("edits").isNotNull()
    return done.select("doc_id", "para_idx", F.when(has, F.col("r.text")).otherwise(F.col("output")).alias("output"), F.when(has, F.size("edits")).otherwise(0).alias("n_edits"), F.col("r.missing").alias("missing"))


def revert_edits(edits: DataFrame, reverted: DataFrame) -> DataFrame:
    """Edits without those in ``reverted(doc_id, para_idx, seq)``."""
    return edits.join(reverted.select("doc_id", "para_idx", "seq"), ["doc_id", "para_idx", "seq"], "left_anti")


def manual_edits(paragraphs: DataFrame, edits: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New base paragraphs and the edits that stay. ``manual(doc_id, para_idx, text)`` replaces a paragraph and its
    edits; empty lines inside collapse, and an empty text is refused."""
    new = manual.select("doc_id", "para_idx", F.regexp_replace("text", r"\n[ \t]*\n+", "\n").alias("new")).filter(F.trim("new") != "")
    base = paragraphs.join(new, ["doc_id", "para_idx"], "left").withColumn("output", F.coalesce("new", "output")).drop("new")
    return base, edits.join(new.select("doc_id", "para_idx"), ["doc_id", "para_idx"], "left_anti")


def touched_documents(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with an edit: those to score again."""
    return docs.join(edits.select("doc_id").distinct(), "doc_id", "left_semi")


def recompute(paragraphs: DataFrame, edits: DataFrame, rules: Rules, *, sep: str = "\n\n", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_edits and the scores of the replayed text, of documents with an edit; no other is read on."""
    replayed = replay_edits(touched_documents(paragraphs, edits), edits)
    own = F.array_sort(F.collect_list(F.struct("para_idx", "output")))
    docs = replayed.groupBy("doc_id").agg(F.transform(own, lambda p: p["output"]).alias("p"), F.sum("n_edits").alias("n_edits"))
    return docs.select("doc_id", "n_edits", score_in_row(F.array_join("p", sep), F.col("p"), rules, weights).alias("s")).select("doc_id", "n_edits", "s.*")


def with_nth(flags: DataFrame) -> DataFrame:
    """``flags(doc_id, para_idx, found, start)`` with ``nth``: which occurrence of the same words it is, from 0."""
    return flags.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "para_idx", "found").orderBy("start")) - 1)


def work_list(flags: DataFrame) -> DataFrame:
    """``flags`` with position and n of each in its document, in reading order, whole-document flags last."""
    order = Window.partitionBy("doc_id").orderBy(F.col("para_idx").asc_nulls_last(), F.col("start").asc_nulls_last(), "type", "found")
    return flags.withColumn("position", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))


def visible(flags: DataFrame, hidden: list[str]) -> DataFrame:
    """Flags of the dimensions that aren't hidden."""
    return flags.filter(~F.col("dim").isin(hidden)) if hidden else flags
