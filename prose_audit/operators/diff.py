"""Word-level differences of a paragraph and its rewrite."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import NOT_WS, WS

#: Tokens of a paragraph beyond which no difference is taken, unless ``most`` says otherwise; cells of a table that is held whole.
MOST_TOKENS, TABLE_CELLS = 800, 1_000_000
OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))
_TOKEN = re.compile(f"{WS}+|{NOT_WS}+")


def _longest_common(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Keep, delete and add steps by a table of longest common subsequences, a row of it at a time."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    x, y = (np.array([numbers[w] for w in s], np.int64) for s in (a, b))
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        # a row is the running maximum, from the right, of what a match here or the row below gives
        best = np.maximum(table[i + 1, :-1], np.where(y == x[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("keep", a[i]))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out + [("del", w) for w in a[i:]] + [("add", w) for w in b[j:]]


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and every beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        best = np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(best)
    return row


def _steps(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The same as ``_longest_common`` in memory that grows with the texts alone: long ones are cut where a longest common
    subsequence passes the middle of the first."""
    if not a or not b or (len(a) + 1) * (len(b) + 1) <= TABLE_CELLS or len(a) == 1:
        return _longest_common(a, b)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    x, y = (np.array([numbers[w] for w in s], np.int64) for s in (a, b))
    half = len(a) // 2
    cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    return _steps(a[:half], b[:cut]) + _steps(a[half:], b[cut:])


def difference(original: str, output: str, most: int | None = MOST_TOKENS) -> list[tuple[str, str]]:
    """Runs of kept, deleted and added text. Changes that only touch white space count as kept. Texts of over ``most`` tokens
    are skipped; None takes all."""
    a, b = _TOKEN.findall(original), _TOKEN.findall(output)
    if most is not None and max(len(a), len(b)) > most:
        return [("skip", output)]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    steps = [("keep", w) for w in a[:head]] + _steps(a[head : len(a) - tail], b[head : len(b) - tail]) + [("keep", w) for w in a[len(a) - tail :]]
    out: list[tuple[str, str]] = []
    gone, new = "", ""

    def put(op: str, text: str) -> None:
        if text and out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + text)
        elif text:
            out.append((op, text))

    def close() -> None:
        nonlocal gone, new
        if gone.strip() or new.strip():
            put("del", gone)
            put("add", new)
        else:
            put("keep", new)
        gone = new = ""

    for k, (op, word) in enumerate(steps):
        if op == "del":
            gone += word
        elif op == "add":
            new += word
        elif word.isspace() and (gone or new) and k + 1 < len(steps) and steps[k + 1][0] != "keep":
            gone, new = gone + word, new + word  # a space between two changes belongs to one of them
        else:
            close()
            put("keep", word)
    close()
    return out


def paragraph_diff(original: Column, output: Column, most: int | None = MOST_TOKENS) -> Column:
    """array<struct<op, text>> with op keep, del, add, or skip for paragraphs of over ``most`` tokens (None: no skips)."""

    @F.pandas_udf(OPS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([[{"op": o, "text": t} for o, t in difference(x or "", y or "", most)] for x, y in zip(a, b)])

    return run(original, output)


def diff_paragraphs(paragraphs: DataFrame, most: int | None = MOST_TOKENS) -> DataFrame:
    """``paragraphs(doc_id, para_idx, original, output)`` that differ, with ``ops`` and ``n_changes``; equal ones
    never reach the helper."""
    changed = paragraphs.filter(~F.col("original").eqNullSafe(F.col("output"))).withColumn("ops", paragraph_diff(F.col("original"), F.col("output"), most))
    before = F.concat(F.array(F.lit("keep")), F.transform(F.slice("ops", 1, F.greatest(F.size("ops") - 1, F.lit(0))), lambda o: o["op"]))
    starts = F.filter(F.arrays_zip(F.transform("ops", lambda o: o["op"]).alias("op"), before.alias("last")), lambda z: (z["op"] != "keep") & z["last"].isin("keep", "skip"))
    return changed.withColumn("n_changes", F.when(F.exists("ops", lambda o: o["op"] == "skip"), F.lit(None).cast("int")).otherwise(F.size(starts)))
