"""Studies over a corpus: readability, calibration, style distance, language by letter sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import pieces
from ..sources import sinks

#: Function words that a style is told by; a parameter of ``style_distance``.
FUNCTION_WORDS = (
    "the of and to a in that it is was i for on you he be with as by at have are this not but had his they from she which or we an were her their been has "
    "would there what will all if can one so no who my up out them then when me some could into its other than do your about only any our these over such "
    "after down should because each just those how too very where most same against while before between under though"
).split()


def readability(docs: DataFrame) -> DataFrame:
    """``docs`` with score, grade, words, sentences, avg_sentence."""
    return docs.withColumn("f", X.flesch(F.coalesce("text", F.lit("")))).select(*docs.columns, "f.*")


def readability_report(docs: DataFrame, *by: str) -> DataFrame:
    """Per group: docs, words, mean, least and greatest score, mean grade, and quartiles of the score."""
    return (
        readability(docs.select(*by, "text"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("docs"), F.sum("words").alias("words"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
            F.avg("grade").alias("avg_grade"), F.percentile_approx("score", [0.25, 0.5, 0.75], 10000).alias("quartiles"),
        )
    )


def class_rates(scores: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``scores(doc_id, total)`` and ``labels(doc_id, class)`` → class, docs, over (share at or above the threshold),
    mean, stdev, least, greatest."""
    rows = scores.join(labels, "doc_id").groupBy("class")
    return rows.agg(
        F.count("*").alias("docs"), F.avg((F.col("total") >= threshold).cast("double")).alias("over"), F.avg("total").alias("mean"),
        F.stddev_pop("total").alias("stdev"), F.min("total").alias("least"), F.max("total").alias("greatest"),
    )


def class_separation(rates: DataFrame) -> DataFrame:
    """Of each pair of classes: the difference of means over the pooled deviation, and whether ranges overlap."""
    a, b = rates.alias("a"), rates.alias("b")
    pooled = F.sqrt((F.col("a.stdev") ** 2 + F.col("b.stdev") ** 2) / 2)
    return a.join(b, F.col("a.class") < F.col("b.class")).select(
        F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"),
        F.when(pooled > 0, (F.col("a.mean") - F.col("b.mean")) / pooled).alias("separation"),
        ((F.col("a.least") <= F.col("b.greatest")) & (F.col("b.least") <= F.col("a.greatest"))).alias("overlap"),
    )


def thresholds(scores: DataFrame, labels: DataFrame, shares: list[float], *, exact: bool = True) -> DataFrame:
    """class, share, threshold: percentiles of the score in each class."""
    named = F.array(*map(F.lit, shares))
    value = F.percentile("total", named) if exact else F.percentile_approx("total", shares, 10000)
    rows = scores.join(labels, "doc_id").groupBy("class").agg(value.alias("v"))
    return rows.select("class", F.explode(F.arrays_zip(named.alias("share"), F.col("v").alias("threshold"))).alias("z")).select("class", "z.*")


#: Size of a quantile sketch, and the error of a rank that it keeps to but for one case in many.
SKETCH_SIZE, RANK_ERROR = 400, 0.02


def score_sketches(scores: DataFrame, *by: str) -> DataFrame:
    """``by`` (class and day, say), sketch, docs: a quantile sketch (KLL) of the totals of each group, some kilobytes
    whatever its size, to be stored and merged later. Null totals are left out."""
    return scores.filter("total is not null").groupBy(*by).agg(F.kll_sketch_agg_double("total", F.lit(SKETCH_SIZE)).alias("sketch"), F.count("*").alias("docs"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups, from stored ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"), F.sum("docs").alias("docs"))


def sketch_thresholds(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """The sketches' columns but the sketch, with share and threshold: percentiles whose rank is RANK_ERROR off at most."""
    named = F.array(*map(F.lit, shares))
    values = F.kll_sketch_get_quantile_double("sketch", named)
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, F.explode(F.arrays_zip(named.alias("share"), values.alias("threshold"))).alias("z")).select(*keep, "z.*")


def rank_errors(thresholds: DataFrame, scores: DataFrame, by: str) -> DataFrame:
    """``thresholds`` with ``rank_error``: how far the share of the group's totals at the threshold is off the one asked for.

    Thresholds are as many as groups and shares; they are gathered by group first."""
    asked = thresholds.groupBy(by).agg(F.collect_list(F.struct("share", "threshold")).alias("asked"))
    met = scores.filter("total is not null").join(asked, by).select(by, "total", F.explode("asked").alias("a"))
    ranks = met.groupBy(by, "a").agg(F.avg((F.col("total") < F.col("a.threshold")).cast("double")).alias("below"), F.avg((F.col("total") <= F.col("a.threshold")).cast("double")).alias("within"))
    error = F.greatest(F.lit(0.0), F.col("below") - F.col("a.share"), F.col("a.share") - F.col("within"))
    return thresholds.join(ranks.select(by, F.col("a.share").alias("share"), error.alias("rank_error")), [by, "share"])


def word_rates(docs: DataFrame, key: str, words: list[str]) -> DataFrame:
    """key, word, rate: occurrences per word of the text. Only the words looked for are shuffled, summed in tasks;
    keyed by text and word, so that no frequent word is one group. A text is read once: its size goes along as the row
    of no word."""
    own = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:'[a-z]+)*"), F.lit(0))
    size = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.size("w").cast("long").alias("n")))
    found = F.transform(F.filter("w", lambda x: x.isin(words)), lambda x: F.struct(x.alias("word"), F.lit(0).cast("long").alias("n")))
    rows = docs.filter(F.col(key).isNotNull()).select(key, own.alias("w")).select(key, F.explode(F.concat(size, found)).alias("x")).select(key, "x.*")
    counts = rows.groupBy(key, "word").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    placed = counts.withColumn("n", F.max("n").over(Window.partitionBy(key))).filter("word is not null")
    return placed.select(key, "word", (F.col("c") / F.col("n")).alias("rate"))


def most_frequent(docs: DataFrame, words: list[str], n: int = 150) -> list[str]:
    """The ``n`` most frequent of the words over the corpus."""
    found = docs.select(F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:'[a-z]+)*"), F.lit(0)), lambda x: x.isin(words))).alias("word"))
    return [r.word for r in found.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()]


def style_distance(docs: DataFrame, baselines: DataFrame, words: list[str] = FUNCTION_WORDS, n: int = 150) -> DataFrame:
    """Burrows's Delta of every document from every author: doc_id, author_id, delta.

    Rates of the ``n`` most frequent function words become z-scores by the corpus's mean and deviation, where a
    word that a document hasn't counts as 0. Authors' vectors are means over ``baselines(author_id, text)``: n rows
    an author.
    """
    chosen = most_frequent(docs, words, n) or words[:1]
    rates = sinks.stored(word_rates(docs, "doc_id", chosen), "rates")  # for deviations and for documents
    total = docs.count()
    stats = rates.groupBy("word").agg((F.sum("rate") / total).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("rate") ** 2) / total - (F.sum("rate") / total) ** 2)).alias("dev")).filter("dev > 0")
    authors = baselines.select("author_id", F.monotonically_increasing_id().alias("sample_id"), "text")
    samples = authors.groupBy("author_id").agg(F.count("*").alias("samples"))
    by_sample = word_rates(authors.select(F.concat_ws("\0", "author_id", "sample_id").alias("k"), "text"), "k", chosen).withColumn("author_id", F.substring_index("k", "\0", 1))
    mean = by_sample.groupBy("author_id", "word").agg(F.sum("rate").alias("r")).join(samples, "author_id").select("author_id", "word", (F.col("r") / F.col("samples")).alias("author_rate"))
    # z(document) - z(author) = (rate - author rate) / dev: words that both lack add 0
    grid = samples.select("author_id").join(stats.select("word", "dev"), F.lit(True)).join(mean, ["author_id", "word"], "left").fillna(0.0, ["author_rate"])
    vectors = grid.groupBy("author_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("author_rate", "dev")))).alias("v"))
    own = rates.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "rate"))).alias("r"))
    # both in the order of the words, looked up once for each document and each author; a word that doesn't vary is null
    rows = docs.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.array(*[F.coalesce(F.try_element_at("r", F.lit(w)), F.lit(0.0)) for w in chosen]).alias("r"))
    placed = vectors.select("author_id", F.size("v").alias("n"), F.array(*[F.try_element_at("v", F.lit(w)) for w in chosen]).alias("v"))
    terms = F.zip_with("r", "v", lambda x, e: F.coalesce(F.abs(x - e["author_rate"]) / e["dev"], F.lit(0.0)))
    return rows.join(F.broadcast(placed), F.lit(True)).select("doc_id", "author_id", (F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.col("n")).alias("delta"))


def letters(text: Column) -> Column:
    """The text's words in lower case, padded with underscores: what letter sequences are cut from."""
    return F.concat(F.lit("_"), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", "_"), F.lit("_")), F.lit("_"))


def gram_counts(padded: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different sequences of ``n`` letters, in order, and how often each comes up. Up to three are packed into a number,
    21 bits a letter."""
    if len(padded) < n or padded == "__":
        return np.array([], np.int64 if n <= 3 else f"U{n}"), np.array([], np.int64)
    if n > 3:
        return np.unique(np.array([padded[i : i + n] for i in range(len(padded) - n + 1)]), return_counts=True)
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    keys = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        keys = keys << 21 | codes[k : len(codes) - n + 1 + k]
    return np.unique(keys, return_counts=True)


def gram_texts(keys: np.ndarray, n: int) -> list[str]:
    return ["".join(chr(int(x) >> 21 * k & 0x1FFFFF) for k in range(n - 1, -1, -1)) for x in keys] if n <= 3 else keys.tolist()


def gram_keys(texts: list[str], n: int) -> np.ndarray:
    """Sequences as ``gram_counts`` has them."""
    return np.array([sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(t)) for t in texts], np.int64) if n <= 3 else np.array(texts, f"U{n}")


def all_grams(texts: DataFrame, key: str, n: int) -> DataFrame:
    """key, gram, count of ``texts(key, p)``, see ``letters``; counted by text, and summed for pieces of batches before they
    are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for own in pieces(iter([b["p"]])):
                for value, some in own.groupby(b[key].iloc[at : at + len(own)].to_numpy()):
                    found = [gram_counts(p, n) for p in some]
                    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                    number = np.bincount(where, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                    yield pd.DataFrame({key: value, "gram": gram_texts(keys, n), "count": number})
                at += len(own)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "p").mapInPandas(count, f"{key} {kind}, gram string, count long").groupBy(key, "gram").agg(F.sum("count").alias("count"))


def language_profiles(docs: DataFrame, *, top: int = 300, n: int = 3) -> DataFrame:
    """lang, gram, rank: the most frequent letter sequences of each language of ``docs(lang, text)``."""
    counts = all_grams(docs.filter("lang is not null").select("lang", letters(F.col("text")).alias("p")), "lang", n)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))).filter(F.col("rank") <= top).select("lang", "gram", "rank")


def nearest_ranking(padded: Column, profiles: list[tuple[str, str, int]], top: int, n: int) -> Column:
    """The language of ``profiles(lang, gram, rank)`` whose ranking is nearest to that of a text (see ``letters``), in its row."""
    langs = sorted({lang for lang, _, _ in profiles})
    table = np.unique(gram_keys([g for _, g, _ in profiles], n))
    ranks = np.zeros((len(table), len(langs)), np.int64)  # 0: not in the profile
    for at, (lang, _, rank) in zip(np.searchsorted(table, gram_keys([g for _, g, _ in profiles], n)), profiles):
        ranks[at, langs.index(lang)] = rank

    def one(p: str) -> str | None:
        keys, number = gram_counts(p, n)
        own = keys[np.argsort(-number, kind="stable")[:top]]
        if not len(own) or not len(table):
            return None
        at = np.minimum(np.searchsorted(table, own), len(table) - 1)
        met = table[at] == own
        rows = ranks[at[met]]
        gain = np.where(rows > 0, np.abs(np.flatnonzero(met)[:, None] + 1 - rows) - top, 0).sum(axis=0)
        found = np.flatnonzero((rows > 0).any(axis=0))
        return langs[found[gain[found].argmin()]] if len(found) else None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pieces(batches):
            yield pd.Series([one(p) for p in batch], dtype=object)

    return run(padded)


def detect_language(docs: DataFrame, profiles: DataFrame, *, top: int = 300, n: int = 3) -> DataFrame:
    """doc_id, lang_pred: the language whose ranking is nearest to the document's own, by the sum of rank
    differences; null for a document without letters or doc_id. Profiles have ``top`` rows a language and go to all tasks.

    Texts are ranked in their row, however long. The texts of a repeated doc_id are one document; of those alone
    the sequences are shuffled."""
    known = [(r.lang, r.gram, r["rank"]) for r in profiles.collect()]
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    own = docs.select("doc_id", letters(F.col("text")).alias("p"))
    here = own.select("doc_id", F.when(F.col("doc_id").isNotNull(), nearest_ranking(F.col("p"), known, top, n)).alias("lang_pred"))
    if again.isEmpty():
        return here
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "gram")
    ranked = all_grams(own.join(again, "doc_id", "left_semi"), "doc_id", n).withColumn("own_rank", F.row_number().over(order)).filter(F.col("own_rank") <= top)
    met = ranked.join(F.broadcast(profiles), "gram").groupBy("doc_id", "lang").agg(F.sum(F.abs(F.col("own_rank") - F.col("rank")) - top).alias("gain"))
    pooled = again.join(met.groupBy("doc_id").agg(F.min_by("lang", F.struct("gain", "lang")).alias("of_all")), "doc_id", "left").withColumn("again", F.lit(True))
    return here.join(pooled, "doc_id", "left").select("doc_id", F.when(F.col("again"), F.col("of_all")).otherwise(F.col("lang_pred")).alias("lang_pred"))


def top_per_group(rows: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the greatest value, ties by ``tie``; rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))).filter(F.col("rank") <= k)
