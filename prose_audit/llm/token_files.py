"""Token ids in flat binary files, with 64-bit document offsets, written and read in document order.

Documents are range-partitioned and sorted by doc_id. Each task encodes its range and writes three files:
``.bin`` (ids as unsigned 16- or 32-bit little-endian integers, without a header), ``.off`` (int64
offsets of its documents, one more than documents) and ``.doc`` (int64 doc_ids and a validity byte
each). The token counts of the parts, one row per part, give the bases of the parts as prefix sums.
Readers memory-map the files.

Defined cases: a null text is the empty text and has the end id alone; a null doc_id comes first; rows
with equal doc_ids are ordered by a hash of the text, then by the text, and need not lie in one part; strings of
special tokens in a text are those tokens, as in the library; an empty table gives no documents. Other columns
are dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, arrow_schema, file_system, map_batches, new_folder, write_file

#: Bytes, about, in which a worker remembers ids of words; a full memory starts anew. Words longer than LONGEST
#: characters are encoded each time.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 256 << 20, 200, 200
#: Separators that Python's split() takes for white space and the tokenizer doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: The tokenizer's own cut into pre-tokens, for lower-cased texts of Latin-1 characters (which are in NFC).
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


class WordEncoder:
    """Ids of whole texts from the tokenizers library.

    The vocabulary lower-cases, drops white space and merges nothing across pre-tokens, so a text's ids are
    those of its pre-tokens; what comes up again isn't encoded again. Texts of Latin-1 characters are cut into
    pre-tokens here, others at white space; one with a character that Python and the tokenizer take for
    different kinds, or with the string of a special token, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        if self.special(text):
            return [text]
        try:
            text.encode("latin-1")
            return PRE_TOKENS.findall(text.lower())
        except UnicodeEncodeError:
            return [text] if any(c in text for c in ODD_SPACES) else text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is new in any of them goes to the library in one call."""
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        cut = [self._cut(t) for t in texts]
        new = list(dict.fromkeys(filterfalse(memo.__contains__, chain.from_iterable(cut))))
        long: dict[str, bytes] = {}
        for word, ids in zip(new, self._encode(new) if new else []):
            if len(word) > LONGEST:
                long[word] = ids
            else:
                memo[word] = ids
                self.held += ENTRY_BYTES + 2 * len(word) + len(ids)
        if long:
            return [b"".join([long[w] if w in long else memo[w] for w in words]) for words in cut]
        return [b"".join(map(memo.__getitem__, words)) for words in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, folder: str | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text)`` and returns the manifest: part, path, base, n_docs, n_tokens, width.

    ``base`` is the number of ids in all parts before. The manifest has one row per part, so it fits the
    driver, where the prefix sums are taken.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    schema = "part int, path string, n_docs long, n_tokens long, width int"
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(tokenizer_path), TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}"
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        end = np.array([end_id], own.dtype).tobytes()

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                column = batch.column(0)
                ids.append(np.stack([column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), column.is_valid().to_numpy(zero_copy_only=False).astype("<i8")]))
                for got in own.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                    lengths.append(len(got) // np.dtype(own.dtype).itemsize + 1)
                    yield got + end

        attempt = f"{task.stageId()}-{task.taskAttemptId()}"
        write_file(f"{path}.bin", encoded(), attempt)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8")
        write_file(f"{path}.off", [offsets.tobytes()], attempt)
        both = np.concatenate(ids, axis=1) if ids else np.zeros((2, 0), "<i8")
        write_file(f"{path}.doc", [both[0].astype("<i8").tobytes(), both[1].astype("u1").tobytes()], attempt)
        row = [part, path, len(lengths), int(offsets[-1]), np.dtype(own.dtype).itemsize]
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, out)], schema=out)

    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    parts = sorted(map_batches(ordered, run, schema).collect(), key=lambda r: r.part)
    base = np.concatenate([[0], np.cumsum([r.n_tokens for r in parts], dtype=np.int64)]).tolist()
    rows = [(r.part, r.path, base[i], r.n_docs, r.n_tokens, r.width) for i, r in enumerate(parts)]
    return spark.createDataFrame(rows, "part int, path string, base long, n_docs long, n_tokens long, width int")


class Integers:
    """A file's integers by ranges: memory-mapped where it lies, or read by range if it isn't on a mounted file
    system."""

    def __init__(self, uri: str, dtype: str) -> None:
        system, path = file_system(uri)
        self.dtype = np.dtype(dtype)
        self.local = system.type_name == "local"
        if self.local:
            self.data = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        else:
            self.file = system.open_input_file(path)

    def range(self, start: int, end: int) -> np.ndarray:
        if self.local:
            return self.data[start:end]
        return np.frombuffer(self.file.read_at((end - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def read_token_files(manifest: DataFrame, *, ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, token_ids.

    ``start`` is the number of ids of all documents before; ids_crc32 is the unsigned CRC-32 of the ids as
    little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * ids
    out = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offset_file, doc, tokens = (Integers(f"{row['path']}.{end}", kind) for end, kind in (("off", "<i8"), ("doc", "u1"), ("bin", f"<u{row['width']}")))
                n = row["n_docs"]
                for at in range(0, n, ARROW_ROWS):
                    to = min(n, at + ARROW_ROWS)
                    doc_ids, valid = doc.range(8 * at, 8 * to).view("<i8"), doc.range(8 * n + at, 8 * n + to).astype(bool)
                    offsets = np.asarray(offset_file.range(at, to + 1))
                    spans = [np.asarray(tokens.range(a, b)).astype("<u4") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    columns = [
                        pa.array(np.asarray(doc_ids), mask=~valid),
                        pa.array(row["base"] + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(x.tobytes()) for x in spans], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([x.astype("<i4") for x in spans], type=out.field("token_ids").type))
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(run, schema)
