"""Batches of helpers in pieces, so that what a piece becomes fits a worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters of a piece; a longer text is a piece of its own.
CHARS = 1 << 20


def _size(value) -> int:
    """Characters of a text or of a sequence of texts."""
    return 0 if value is None else len(value) if isinstance(value, str) else sum(len(t or "") for t in value)


def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches' rows in order, in pieces of CHARS characters at most, or of one row."""
    for batch in batches:
        begin = held = 0
        for k, value in enumerate(batch):
            n = _size(value)
            if k > begin and held + n > CHARS:
                yield batch.iloc[begin:k]
                begin, held = k, 0
            held += n
        yield batch.iloc[begin:]
