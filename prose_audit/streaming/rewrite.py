"""The rewrite on streams. It is row-local, so it keeps no state and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import flags, rewrite
from ..sources.rules import Rules


def rewrite_stream(docs: DataFrame, rules: Rules, *, sep: str = "\n\n") -> DataFrame:
    """A stream (or table) of documents with output, n_changes, flags and readability of the output; append mode."""
    done = rewrite.rewrite_documents(docs, rules, sep=sep)
    out = done.withColumn("output", rewrite.output_text(sep)).withColumn("n_changes", rewrite.change_count()).drop("paragraphs")
    return flags.flag_documents(out, rules, text="output").withColumn("readability", X.flesch(F.col("output")))
