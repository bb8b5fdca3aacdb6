"""The prose functions for SQL: table functions over a text, and the rewrite as a scalar one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.rules import Rules

SENTENCES = "number int, start int, `end` int, sentence string"
FLAGS = "start int, `end` int, type string, dim string, found string, reason string, suggestion string, kind string"
SPLITS = "kind string, tier int, start int, `end` int, `left` string, `right` string"


def register(spark: SparkSession, rules: Rules) -> None:
    """Registers ``prose_sentences(text)``, ``prose_flags(text)`` and ``prose_splits(text)``, to be used in FROM with
    LATERAL, and ``prose_rewrite(text)``. A null text has no rows, and null as its rewrite."""
    from ..operators.flags import Reviewer
    from ..operators.rewrite import Rewriter
    from ..operators.spans import find_sentences
    from ..operators.splits import Splitter

    class Sentences:
        def eval(self, text: str) -> Iterator[tuple]:
            for i, (a, b, s) in enumerate(find_sentences(text or "")):
                yield i, a, b, s

    class Flags:
        def __init__(self) -> None:
            self.own = Reviewer(rules)

        def eval(self, text: str) -> Iterator[tuple]:
            for a, b, kind, dim, found, reason, advice, how, *_ in self.own.review(text or ""):
                yield a, b, kind, dim, found, reason, advice, how

    class Splits:
        def __init__(self) -> None:
            self.own = Splitter(rules)

        def eval(self, text: str) -> Iterator[tuple]:
            for kind, tier, a, b, _, _, _, left, right, *_ in self.own.find(text or ""):
                yield kind, tier, a, b, left, right

    for name, handler, schema in (("prose_sentences", Sentences, SENTENCES), ("prose_flags", Flags, FLAGS), ("prose_splits", Splits, SPLITS)):
        spark.udtf.register(name, F.udtf(handler, returnType=schema, useArrow=True))

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Rewriter(rules)
        for batch in batches:
            yield pd.Series([None if t is None else own.rewrite(t)[0] for t in batch])

    spark.udf.register("prose_rewrite", rewrite)
