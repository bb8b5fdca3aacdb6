"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is merged by a queue with one bucket per merge rank. A bucket holds linked-list
positions; a bitmap over the ranks, in words with a summary of the words above them, gives the next rank
by find-first-set. Entries that a later merge made stale are skipped when they come up, so even
a pre-token of a whole document takes near-linear time. The new pre-tokens of many texts share one queue: what
comes up is a whole bucket, of which each pre-token merges its leftmost position, all of them at once.

Defined cases: a null text is the empty text, which has no ids and decodes to no bytes; repeated rows
are encoded alike; other columns of the input pass through untouched unless their names clash with the
result's, which then win; an empty table gives no rows; a long text is encoded whole, in memory in proportion to the
longest one, also where it is a single pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from operator import getitem

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, map_batches

#: Bytes, about, in which a worker remembers ids of pre-tokens and of words with the space before them. Half of them
#: are for what is new or came up again since the other half was full, which goes when this one is. What is longer
#: than LONGEST characters is merged each time.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 128 << 20, 160, 200
#: A pre-token of more bytes is merged in arrays of 32-bit integers instead of lists: slower, with less memory.
LONG_PIECE = 1 << 14
#: Bytes of ids that are decoded at once.
DECODED = 1 << 20
#: Characters of texts, about, whose new pre-tokens share one queue; a longer text's are merged one by one.
GATHERED = 2 << 20
#: Fewer pre-tokens than this are merged one by one; buckets of fewer positions position by position.
SHARED_PIECES, SHARED_POSITIONS = 64, 48


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the token's bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: Ranks in one word of the bitmap; the summary word has a bit for each word that isn't zero.
WORD_BITS = 8


class Bucket:
    """Positions of one rank in a long pre-token. They wait in an array, which is sorted when the rank's turn comes; those
    that come after that go to a heap."""

    __slots__ = ("waiting", "late", "sorted")

    def __init__(self, positions: bytes = b"") -> None:
        self.waiting, self.late, self.sorted = array("i", positions), [], False

    def push(self, i: int) -> None:
        if self.sorted:
            heappush(self.late, i)
        else:
            self.waiting.append(i)

    def pop(self) -> int:
        """The smallest position."""
        if not self.sorted:
            self.waiting = array("i", np.sort(np.frombuffer(self.waiting, np.int32))[::-1].tobytes())
            self.sorted = True
        if self.late and (not self.waiting or self.late[0] < self.waiting[-1]):
            return heappop(self.late)
        return self.waiting.pop()

    def __bool__(self) -> bool:
        return bool(self.waiting or self.late)


def by_rank(ranks: np.ndarray, positions: np.ndarray) -> list[tuple[int, list[int]]]:
    """The positions of each rank that isn't -1."""
    positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    ranks, own = ranks[order], positions[order].tolist()
    starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])[: len(ranks)])
    ends = [*starts[1:].tolist(), len(own)]
    return [(rank, own[a:b]) for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), ends)]


class Merger:
    """Merges pre-tokens by the ranks of one vocabulary.

    The queue's bitmap, ``words``, and its buckets are empty between two pre-tokens, so they are kept.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = [0] * ((max(ranks.values(), default=0) >> WORD_BITS) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.two = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        self.tables: tuple[np.ndarray, ...] | None = None

    def _pairs(self) -> tuple[np.ndarray, ...]:
        """For pre-tokens that share a queue: the part of each byte (its id; past the ids if it has none), the rank of two bytes
        (-1: none), and by ``left * size + right``, ascending, the ranks of all pairs of parts, after which a guard comes."""
        if self.tables is None:
            past, found = len(self.words) << WORD_BITS, {}
            part = {**{bytes([b]): past + b for b in range(256)}, **self.ranks}
            for piece, rank in self.ranks.items():
                for k in range(1, len(piece)):
                    left, right = part.get(piece[:k]), part.get(piece[k:])
                    if left is not None and right is not None:
                        found[left * (past + 257) + right] = rank
            keys = np.array(sorted(found), np.int64)
            values = np.array([found[k] for k in keys.tolist()] + [-1], np.int32)
            two = np.array([[-1 if x is None else x for x in row] for row in self.two], np.int32)
            self.tables = np.array([part[bytes([b])] for b in range(256)], np.int32), two, np.append(keys, np.iinfo(np.int64).max), values
        return self.tables

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. Every merge joins the pair of smallest rank, the leftmost of equals."""
        get, n = self.ranks.get, len(piece)
        whole = get(piece)
        if whole is not None:
            return [whole]
        # a part begins at each position with an id that is no None, and ends where the next one begins
        ids = list(map(self.single.__getitem__, piece))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = list(map(getitem, map(self.two.__getitem__, piece), piece[1:]))
        words, buckets, summary, mask = self.words, self.buckets, 0, (1 << WORD_BITS) - 1
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # positions ascend, so the bucket stays a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> WORD_BITS
                    words[word] |= 1 << (rank & mask)
                    summary |= 1 << word
        pair.append(None)
        pair.append(None)
        while summary:
            # find-first-set in the summary, then in the word
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            first = bits & -bits
            rank = word << WORD_BITS | first.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits ^ first
                if not bits:
                    summary ^= 1 << word
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            ids[i], ids[gone] = rank, None
            pair[gone] = None
            after[i] = end
            left = before[i]
            if end < n:
                before[end] = i
                pair[i] = own = get(piece[i : after[end]])
                if own is not None:
                    if own in buckets:
                        heappush(buckets[own], i)
                    else:
                        buckets[own] = [i]
                        word = own >> WORD_BITS
                        words[word] |= 1 << (own & mask)
                        summary |= 1 << word
            else:
                pair[i] = None
            if left >= 0:
                pair[left] = own = get(piece[left:end])
                if own is not None:
                    if own in buckets:
                        heappush(buckets[own], left)
                    else:
                        buckets[own] = [left]
                        word = own >> WORD_BITS
                        words[word] |= 1 << (own & mask)
                        summary |= 1 << word
        return [x for x in ids if x is not None]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens that are no tokens as a whole, as bytes: each merged as ``merge`` does, in one queue for all."""
        get, (part, two, keys, values) = self.ranks.get, self._pairs()
        past, size = len(self.words) << WORD_BITS, (len(self.words) << WORD_BITS) + 257
        border = past + 256  # a part of its own around each pre-token, which no pair has
        text = b"\0" + b"\0".join(pieces) + b"\0"
        n, at = len(text), np.frombuffer(text, np.uint8)
        edges = np.concatenate([[0], np.cumsum(np.array([len(p) + 1 for p in pieces], np.int64))])
        parts = part[at]
        parts[edges] = border
        ranks = np.append(two[at[:-1], at[1:]], np.int32(-1))
        ranks[edges] = ranks[edges[1:] - 1] = -1
        owners = np.repeat(np.arange(len(edges), dtype=np.int32), np.diff(edges, append=n))
        ids, pair, owner = (array("i", x.astype(np.int32).tobytes()) for x in (parts, ranks, owners))
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        ids_, pair_, owner_, after_, before_ = (np.frombuffer(x, np.int32) for x in (ids, pair, owner, after, before))
        words, buckets, summary, mask = self.words, self.buckets, 0, (1 << WORD_BITS) - 1
        for rank, some in by_rank(ranks, np.arange(n, dtype=np.int32)):
            buckets[rank] = some
            word = rank >> WORD_BITS
            words[word] |= 1 << (rank & mask)
            summary |= 1 << word
        while summary:
            # find-first-set in the summary, then in the word
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            first = bits & -bits
            rank = word << WORD_BITS | first.bit_length() - 1
            bucket = buckets.pop(rank)
            words[word] = bits = bits ^ first
            if not bits:
                summary ^= 1 << word
            # new pairs, and positions that wait for another one of their pre-token
            changed: list[tuple[int, list[int]]] = []
            if len(bucket) < SHARED_POSITIONS:
                last = -1
                for i in sorted(bucket):
                    if pair[i] != rank:
                        continue  # stale
                    if owner[i] == last:
                        changed.append((rank, [i]))
                        continue
                    last, gone, left = owner[i], after[i], before[i]
                    end = after[gone]
                    ids[i], ids[gone], pair[gone], after[i], before[end] = rank, -1, -1, end, i
                    pair[i] = own = -1 if ids[end] == border else get(text[i : after[end]], -1)
                    if own >= 0:
                        changed.append((own, [i]))
                    if ids[left] != border:
                        pair[left] = own = get(text[left:end], -1)
                        if own >= 0:
                            changed.append((own, [left]))
            else:
                i = np.array(bucket, np.int32)
                i = i[pair_[i] == rank]
                i.sort()
                own = owner_[i]
                leftmost = np.append(True, own[1:] != own[:-1])[: len(i)]
                if not leftmost.all():
                    changed.append((rank, i[~leftmost].tolist()))
                    i = i[leftmost]
                gone, left = after_[i], before_[i]
                end = after_[gone]
                ids_[i], ids_[gone], pair_[gone], after_[i], before_[end] = rank, -1, -1, end, i
                wanted = np.concatenate([ids_[left].astype(np.int64) * size + rank, np.int64(rank * size) + ids_[end]])
                place = np.searchsorted(keys, wanted)
                new = np.where(keys[place] == wanted, values[place], -1)
                left = np.concatenate([left, i])
                pair_[left] = new
                changed += by_rank(new, left)
            for own, some in changed:
                if own in buckets:
                    buckets[own] += some
                else:
                    buckets[own] = some
                    word = own >> WORD_BITS
                    words[word] |= 1 << (own & mask)
                    summary |= 1 << word
        is_id = (ids_ >= 0) & (ids_ < past)
        out, ends = ids_[is_id].astype("<u4").tobytes(), (4 * np.cumsum(is_id)[edges]).tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:])]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one pre-token as bytes, merged as ``merge`` does with arrays in place of lists; -1 is no id, no rank."""
        get, n = self.ranks.get, len(piece)
        whole = get(piece)
        if whole is not None:
            return struct.pack("<I", whole)
        at = np.frombuffer(piece, np.uint8)
        ids = array("i", np.array([-1 if x is None else x for x in self.single], np.int32)[at].tobytes())
        two = np.array([[-1 if x is None else x for x in row] for row in self.two], np.int32)
        ranks = two[at[:-1], at[1:]]
        pair = array("i", np.append(ranks, [-1, -1]).astype(np.int32).tobytes())
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        words, buckets, summary, mask = self.words, {}, 0, (1 << WORD_BITS) - 1

        def put(rank: int, bucket: Bucket) -> None:
            nonlocal summary
            buckets[rank] = bucket
            words[rank >> WORD_BITS] |= 1 << (rank & mask)
            summary |= 1 << (rank >> WORD_BITS)

        order = np.argsort(ranks, kind="stable").astype(np.int32)
        found, starts = np.unique(ranks[order], return_index=True)
        for rank, own in zip(found.tolist(), np.split(order, starts[1:])):
            if rank >= 0:
                put(rank, Bucket(own.tobytes()))
        del order, ranks, own
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            first = bits & -bits
            rank = word << WORD_BITS | first.bit_length() - 1
            bucket = buckets[rank]
            i = bucket.pop()
            if not bucket:
                del buckets[rank]
                words[word] = bits ^ first
                if not words[word]:
                    summary ^= 1 << word
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            ids[i], ids[gone], pair[gone], after[i] = rank, -1, -1, end
            pair[i] = -1
            changed = [(before[i], end)]
            if end < n:
                before[end] = i
                changed.append((i, after[end]))
            for start, stop in changed:
                if start >= 0:
                    own = pair[start] = get(piece[start:stop], -1)
                    if own in buckets:
                        buckets[own].push(start)
                    elif own >= 0:
                        put(own, Bucket(struct.pack("<i", start)))
        out = np.frombuffer(ids, np.int32)
        return out[out >= 0].astype("<u4").tobytes()


class Codec:
    """Encodes and decodes texts with one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.merger = Merger(self.ranks)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by what follows a space, the ids of both
        self.memo_before: dict[str, bytes] = {}
        self.spaced_before: dict[str, bytes] = {}
        self.held = 0
        self.fresh: dict[str, bytes] = {}  # ids of the texts' new pre-tokens while these are encoded
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text; pre-tokens that aren't remembered are first merged together."""
        at = 0
        while at < len(texts):
            own, chars = [], 0
            while at < len(texts) and (not own or chars + len(texts[at]) <= GATHERED):
                own.append(texts[at])
                chars += len(texts[at])
                at += 1
            if chars <= GATHERED:
                self._learn(own)
            yield from map(self.encode, own)
            self.fresh = {}

    def _learn(self, texts: list[str]) -> None:
        """Remembers what the texts have after their spaces, and merges their other new pre-tokens."""
        if self.held > MEMO_BYTES // 2 - MEMO_BYTES // 16:
            self._turn()  # not amid these texts
        spaced, before, old = self.spaced, self.spaced_before, (self.memo, self.memo_before)
        parts: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            first, *rest = text.split(" ")
            new = set(rest).difference(spaced)
            if not first or first[-1].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                pieces.update(self.split(text))
            else:
                pieces.update(self.split(first))
                parts |= new
        cut: dict[str, list[str]] = {}
        for part in parts:
            ids = before.get(part)
            if ids is not None:
                self._remember(spaced, part, ids)
            elif len(part) <= LONGEST:
                cut[part] = self.split(" " + part)
        pieces.update(*cut.values())
        self.fresh, new = {}, []
        for piece in pieces.difference(*old):
            if len(piece) <= LONGEST and not (piece[0] == " " and (piece[1:] in spaced or piece[1:] in before)):
                data = piece.encode()
                ids = self.ranks.get(data)
                if ids is None:
                    new.append((piece, data))
                else:
                    self.fresh[piece] = struct.pack("<I", ids)
        if len(new) < SHARED_PIECES:
            return
        self.fresh.update(zip([p for p, _ in new], self.merger.merge_all([data for _, data in new])))
        for part, (head, *rest) in cut.items():
            # a pre-token with its space is remembered by what follows that, as the part of another text
            own = head[1:]
            ids = self.spaced.get(own)
            if ids is None:
                ids = before.get(own)
                self._remember(self.spaced, own, ids := self._merged(head) if ids is None else ids)
            if rest:
                self._remember(self.spaced, part, ids + self._joined(rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A match never reaches over a single space between two characters that are no white space: it ends
        before the space or begins with it. So a text is cut there, and what follows a space is looked up
        whole; texts with other spaces are split by the pattern alone.
        """
        first, *rest = text.split(" ")
        spaced = self.spaced
        try:
            return self._pieces(first) + b"".join([spaced[part] for part in rest])
        except KeyError:
            pass
        if not first or first[-1].isspace():
            return self._pieces(text)
        out = [self._pieces(first)]
        for part in rest:
            ids = spaced.get(part)
            if ids is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._pieces(text)
                ids = self.spaced_before.get(part)
                if ids is None:
                    pieces = self.split(" " + part)
                    # one pre-token is remembered here alone
                    ids = self._merged(pieces[0]) if len(pieces) == 1 else self._pieces(" " + part)
                self._remember(self.spaced, part, ids)
                spaced = self.spaced
            out.append(ids)
        return b"".join(out)

    def _remember(self, memo: dict[str, bytes], part: str, ids: bytes) -> None:
        if len(part) <= LONGEST:
            memo[part] = ids
            self.held += ENTRY_BYTES + 2 * len(part) + len(ids)
            if self.held > MEMO_BYTES // 2:
                self._turn()

    def _turn(self) -> None:
        self.memo_before, self.spaced_before = self.memo, self.spaced
        self.memo, self.spaced, self.held = {}, {}, 0

    def _merged(self, part: str) -> bytes:
        ids = self.fresh.get(part)
        if ids is not None:
            return ids
        piece = part.encode()
        if len(piece) > LONG_PIECE:
            return self.merger.merge_long(piece)
        ids = self.merger.merge(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        return self._joined(self.split(text))

    def _joined(self, parts: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[part] for part in parts])
        except KeyError:
            pass
        out = []
        for part in parts:
            ids = memo.get(part)
            if ids is None and part[0] == " ":
                ids = self.spaced.get(part[1:])
            if ids is None:
                ids = self.memo_before.get(part)
                if ids is None:
                    ids = self._merged(part)
                self._remember(self.memo, part, ids)
                memo = self.memo
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        parts = (np.frombuffer(ids[k : k + DECODED], "<u4").tolist() for k in range(0, len(ids), DECODED))
        return b"".join([b"".join(map(self.pieces.__getitem__, part)) for part in parts])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``token_ids`` (array<int>).

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that decoding
    these ids gives.
    """
    new = ["token_ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = df.drop(*(c for c in new if c != text_col))
    types = {"token_ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    ddl = ", ".join(f"{c} {types[c]}" for c in new)
    added = arrow_schema(df.sparkSession, ddl)
    at = keep.columns.index(text_col)
    schema = StructType([*keep.schema.fields, *StructType.fromDDL(ddl).fields])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in new}
            for got in own.encode_all([text or "" for text in batch.column(at).to_pylist()]):
                if ids:
                    out["token_ids"].append(np.frombuffer(got, "<i4"))
                out["n_tokens"].append(len(got) // 4)
                out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(own.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(out[f.name], type=f.type) for f in added)],
                names=[*batch.schema.names, *added.names],
            )

    return map_batches(keep, run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, *, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in ``out_col``; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""

    @F.pandas_udf("string")
    def texts(column):
        own = codec(path, pattern)
        return column.map(lambda a: "" if a is None else own.decode(np.asarray(a, "<u4").tobytes()).decode("utf-8", "replace"))

    return df.withColumn(out_col, texts(ids_col))
