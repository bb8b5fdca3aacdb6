"""URL filters: path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL a log-likelihood
difference per character; a threshold calibrated on URLs that neither model has seen decides. URLs that a
rule allows are the accepted ones, those that one blocks the rejected ones.

A model is a table of counts of ORDER + 1 symbols. The alphabet has 40 symbols whatever the URLs hold, so a
model has 40**4 cells at most and its size is bounded; counts are taken over all URLs, summed in tasks
before the shuffle. Probabilities of shorter contexts are interpolated by Witten-Bell smoothing.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no rule fits an empty host;
with neither accepted nor rejected URLs the ratio is 0 and the threshold 0, which allows; repeated rows get
equal verdicts; an empty table gives no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

#: Symbols: begin and end, a to z, one for digits, the marks below, and one for everything else.
MARKS = "./-_?=&%:#"
ORDER = 3
SYMBOLS = 40
#: URLs with crc32 % FOLDS of 0 calibrate, the others train.
FOLDS = 5
#: The threshold is looked for on this grid of nats per character.
GRID = np.linspace(-4, 4, 801)


def _symbol_of_byte() -> np.ndarray:
    out = np.full(256, SYMBOLS - 1, np.int64)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    for b in b"0123456789":
        out[b] = 27
    for k, mark in enumerate(MARKS.encode()):
        out[mark] = 28 + k
    return out


SYMBOL = _symbol_of_byte()


def split_url(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column, as the rules see them."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict. A rule (verdict, "host/path") fits its host and all
    subdomains, where the path starts with its path; the rules are few and given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 symbols at every position of every URL and its end, and how many each URL has."""
    data = [u.encode() for u in urls]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1 + ORDER
    symbols = np.zeros(int(sizes.sum()), np.int64)
    at = np.cumsum(sizes) - sizes
    inner = np.ones(len(symbols), bool)
    for k in range(ORDER):
        inner[at + k] = False
    codes_at = inner.copy()
    inner[at + sizes - 1] = False
    symbols[inner] = SYMBOL[np.frombuffer(b"".join(data), np.uint8)]
    code = np.zeros(len(symbols), np.int64)
    for k in range(ORDER + 1):
        shifted = np.zeros_like(symbols)
        shifted[k:] = symbols[: len(symbols) - k] if k else symbols
        code += shifted * SYMBOLS**k
    return code[codes_at], sizes - ORDER


def count_grams(labelled: DataFrame) -> DataFrame:
    """``labelled(url, label)`` (label 0 or 1) → label, code, n: counts over all URLs."""
    schema = "label int, code int, n long"
    out = arrow_schema(labelled.sparkSession, schema)
    cells = SYMBOLS ** (ORDER + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.int64)
            urls = batch.column(0).to_pylist()
            if not urls:
                continue
            code, sizes = _grams(urls)
            key, n = np.unique(np.repeat(label, sizes) * cells + code, return_counts=True)
            for k, v in zip(key.tolist(), n.tolist()):  # at most two models' cells
                total[k] = total.get(k, 0) + v
        key = np.fromiter(total.keys(), np.int64, len(total))
        n = np.fromiter(total.values(), np.int64, len(total))
        yield pa.RecordBatch.from_arrays([pa.array((key // cells).astype(np.int32)), pa.array((key % cells).astype(np.int32)), pa.array(n)], schema=out)

    return labelled.select("url", F.col("label").cast("int")).mapInArrow(run, schema).groupBy("label", "code").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the last symbol of each code after the ones before it, all orders interpolated."""
    table = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    prob = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        own = table.sum(axis=tuple(range(ORDER - order))) if order < ORDER else table
        n = own.sum(-1, keepdims=True)
        kinds = (own > 0).sum(-1, keepdims=True)
        weight = np.where(n > 0, n / np.maximum(n + kinds, 1), 0)
        prob = weight * own / np.maximum(n, 1) + (1 - weight) * prob
    return np.log(prob).reshape(-1)


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Log-likelihood ratios by code, and the threshold, from ``labelled(url, label)``; label 1 is accepted.

    Models come from four fifths of the URLs, by a hash of the URL; the threshold is the middle of the
    values with the best mean of both classes' hit rates on the rest, from a histogram over all of them.
    """
    fold = F.crc32(F.col("url").cast("binary")) % FOLDS
    rows = count_grams(labelled.filter(fold != 0)).toPandas()  # 2 * 40**4 rows at most
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    counts[rows["label"].to_numpy(np.int64), rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy()
    ratio = (smoothed(counts[1]) - smoothed(counts[0])).astype(np.float32)
    scored = score(labelled.filter(fold == 0), ratio).withColumn("bin", F.floor((F.col("score") + 4) * 100).cast("int"))
    binned = scored.groupBy("label", F.greatest(F.lit(-1), F.least(F.lit(800), "bin")).alias("bin")).count().collect()
    hits = np.zeros((2, 802))
    for r in binned:
        hits[r.label, r.bin + 1] += r["count"]
    share = hits / np.maximum(hits.sum(1, keepdims=True), 1)
    # at threshold GRID[k], accepted are the bins from k + 1 on
    above = 1 - np.cumsum(share, 1)[:, :801]
    gain = above[1] * (hits[1].sum() > 0) - above[0] * (hits[0].sum() > 0)
    if not hits.sum():
        return ratio, 0.0
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return ratio, float(GRID[best[len(best) // 2]])


def score(urls: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``urls`` (not null in ``url``) with ``score``, the mean ratio over the characters and the end."""
    model = urls.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def mean(column):
        import pandas as pd

        if not len(column):
            return pd.Series([], dtype=float)
        code, sizes = _grams(column.tolist())
        sums = np.add.reduceat(model.value[code].astype(np.float64), np.cumsum(sizes) - sizes)
        return pd.Series(np.round(sums / sizes, 9))

    return urls.withColumn("score", mean("url"))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages(page_id, url)`` → page_id, host, path, rule, verdict, score."""
    host, path = split_url()
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("by_rule", by_rule)
    labelled = split.filter("by_rule is not null").select("url", (F.col("by_rule") == "allow").cast("int").alias("label"))
    ratio, threshold = fit(labelled)
    scored = score(split.withColumn("url", F.coalesce("url", F.lit(""))), ratio)
    by_method = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score")
