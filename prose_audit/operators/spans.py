"""Spans in a paragraph: protected ranges, sentences, and the matches of rules with their offsets.

Offsets are code points from 0, ends exclusive, and ``text[start:end]`` is what was found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import pieces
from ..functions.patterns import ABBREVIATIONS, BLANKS, GUARD, PROTECTED, PROTECTED_HINT, WS
from ..functions.phrases import DisjointSpans

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
SENTENCE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])

Span = tuple[int, int, str]
_PATTERNS = [(kind, re.compile(p, re.ASCII)) for kind, p in PROTECTED]
_HINT = re.compile(PROTECTED_HINT)
_ABBREVIATION = re.compile(rf"\b({ABBREVIATIONS})\.", re.ASCII)
_DECIMAL = re.compile(r"([0-9])\.([0-9])")
_BREAK = re.compile(rf"[.!?]({WS}+)")


def find_protected(text: str, terms: list[str]) -> list[Span]:
    """Code, URLs, e-mail addresses and terms; an earlier kind keeps what a later one would overlap."""
    found: list[Span] = []
    claimed = DisjointSpans()
    patterns = list(_PATTERNS) if _HINT.search(text) else []
    patterns += [("term", re.compile(re.escape(t))) for t in sorted(filter(None, terms), key=len, reverse=True) if t in text]
    for kind, pattern in patterns:
        for m in pattern.finditer(text):
            if claimed.add(m.start(), m.end()):
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for a, b, *_ in spans)


#: Quotes, brackets, entities and link targets, which a split leaves alone too.
_QUOTES = re.compile(rf"\"[^\"]*(?:\"|\Z)|“[^”]*(?:”|\Z)|(?:(?<=\s)|(?<=\A))'(?!{WS})[^']*(?:'(?!\w)|\Z)|&[a-z]+;|&#[0-9]+;|\]\([^)]*(?:\)|\Z)", re.ASCII)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def find_unsplittable(text: str, terms: list[str]) -> list[Span]:
    """Protected ranges plus quotes, brackets, entities and link targets. What is opened and not closed
    reaches to the end of the paragraph."""
    found = find_protected(text, terms)
    found += [(m.start(), m.end(), "quote") for m in _QUOTES.finditer(text)]
    open_: list[tuple[str, int]] = []
    for i, c in enumerate(text):
        if c in _CLOSE:
            open_.append((_CLOSE[c], i))
        elif open_ and c == open_[-1][0]:
            _, start = open_.pop()
            if not open_:
                found.append((start, i + 1, "bracket"))
    if open_:
        found.append((open_[0][1], len(text), "bracket"))
    return sorted(found)


def find_sentences(text: str) -> list[tuple[int, int, str]]:
    """Sentences with their offsets. The guard of abbreviations has the length of what it replaces."""
    guarded = _DECIMAL.sub(rf"\1{GUARD}\2", _ABBREVIATION.sub(rf"\1{GUARD}", text)) if "." in text else text
    bounds = [0, *(x for m in _BREAK.finditer(guarded) for x in m.span(1)), len(text)]
    out = []
    for a, b in zip(bounds[::2], bounds[1::2]):
        part = text[a:b].lstrip(BLANKS)
        own = part.rstrip(BLANKS)
        if own:
            out.append((b - len(part), b - len(part) + len(own), own))
    return out


def _column(result: T.StructType, find):
    names = result.fieldNames()

    @F.pandas_udf(T.ArrayType(result))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pieces(batches):
            yield pd.Series([[dict(zip(names, x)) for x in find(t or "")] for t in batch])

    return run


def protected_ranges(text: Column, terms: list[str] | None = None) -> Column:
    """array<struct<start, end, kind>> of what no rule may touch."""
    return _column(SPAN, lambda t: find_protected(t, terms or []))(text)


def split_protected_ranges(text: Column, terms: list[str] | None = None) -> Column:
    """The same plus quotes, brackets, entities and link targets."""
    return _column(SPAN, lambda t: find_unsplittable(t, terms or []))(text)


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, text>>."""
    return _column(SENTENCE, find_sentences)(text)


def sentence_range(spans: Column, start: Column, end: Column) -> Column:
    """The sentence of ``spans`` (see sentence_spans) that a span lies in, or null."""
    return F.get(F.filter(spans, lambda s: (s["start"] <= start) & (end <= s["end"])), F.lit(0))


def free_of(ranges: Column, start: Column, end: Column) -> Column:
    """Whether a span touches none of the ranges; in the row, without a join."""
    return ~F.exists(ranges, lambda r: (r["start"] < end) & (start < r["end"]))
