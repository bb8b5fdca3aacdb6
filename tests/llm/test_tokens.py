import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prose_audit.llm import bpe, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello world, it's 2024!", "été über  ñandú\n\n\ttab", "a" * 5000, "ab" * 3000, "日本語のテキスト🎉🎉", "x\x1cy\x1f z", "  lead and trail  ",
    "Hello world, it's 2024!", "the " * 400, "​﻿\xa0\x85", "<|endoftext|> is text", "I'LL we've 'S",
]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_tiktoken(oracle):
    own, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abethon .\né'1") for _ in range(rng.randrange(300))) for _ in range(300)]
    for text in texts:
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == oracle.encode_ordinary(text)
        assert own.decode(got) == text.encode()


def test_long_pretokens_are_merged_in_arrays(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_PIECE", 1)
    monkeypatch.setattr(bpe, "DECODED", 8)
    own, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(5)
    for alphabet in ("a", "ab", "thequickbrown", "àé字a", "etaoin-=_"):
        for size in (1, 2, 3, 17, 300, 4000):
            text = "".join(rng.choices(alphabet, k=size))
            got = own.encode(text)
            assert np.frombuffer(got, "<u4").tolist() == oracle.encode_ordinary(text)
            assert own.decode(got) == text.encode()
    # a bucket gives its smallest position, whether it came before the bucket's turn or after
    bucket = bpe.Bucket(np.array([9, 4, 7], np.int32).tobytes())
    bucket.push(6)
    assert bucket.pop() == 4
    bucket.push(5)
    bucket.push(8)
    assert [bucket.pop() for _ in range(5)] == [5, 6, 7, 8, 9] and not bucket


def test_memory_of_one_long_pretoken():
    merger, piece = bpe.Codec(RANKS, P.PATTERN).merger, bytes(random.Random(2).choices(b"thequickbrown", k=200_000))
    tracemalloc.start()
    got = merger.merge_long(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(piece)
    assert np.frombuffer(got, "<u4").tolist() == merger.merge(piece)


def test_merges_equal_a_plain_loop():
    rng = random.Random(1)
    ranks = {bytes([b]): b for b in b"abc"}
    for size in (2, 3, 4, 5):  # any strings at all, not only those that merges can reach in order
        for _ in range(25):
            ranks.setdefault(bytes(rng.choices(b"abc", k=size)), 1000 - len(ranks) * rng.choice((1, 7)) % 997)
    ranks = {k: i for i, k in enumerate(sorted(ranks, key=lambda k: (len(k) > 1, ranks[k], k)))}
    merger = bpe.Merger(ranks)
    for _ in range(500):
        piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while True:
            near = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not near:
                break
            _, i = min(near)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert merger.merge(piece) == [ranks[x] for x in parts]
        assert np.frombuffer(merger.merge_long(piece), "<u4").tolist() == [ranks[x] for x in parts]
        assert not merger.buckets and not any(merger.words)


def test_encode_texts(spark, oracle):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.encode_texts(df, RANKS, P.PATTERN).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = oracle.encode_ordinary(text or "")
        assert rows[i].token_ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode_texts(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_words_equal_the_library():
    tok = Tokenizer.from_file(WORDS)
    own, rng = token_files.encoder(WORDS), random.Random(6)
    latin = [chr(i) for i in range(256)]
    texts = [t or "" for t in TEXTS] + latin + ["a" + c + "b" for c in latin] + ["".join(rng.choices(latin, k=rng.randrange(40))) for _ in range(2000)]
    texts += ["".join(rng.choices("aZé'sStT1½ \xa0.,-\"", k=30)) for _ in range(2000)] + ["".join(rng.choices("aΣσİiı́è é\x1c", k=12)) for _ in range(500)]
    texts += ["<|endoftext|> hi", "a<|ENDOFTEXT|>b é <|startoftext|>", "日本<|endoftext|>語 x", "<|endof text|>", "<| endoftext|>"]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    tok = Tokenizer.from_file(WORDS)
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again"), (40, "<|endoftext|> hi")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = token_files.read_token_files(token_files.write_token_files(df, WORDS, 2)).collect()
    at = 0
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1] or ""))
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.token_ids) == (doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), WORDS, 2)).count() == 0


def test_memories_stay_small():
    rng = random.Random(8)
    words, codec = token_files.WordEncoder(WORDS), bpe.Codec(RANKS, P.PATTERN)
    for k in range(60):
        text = "".join(rng.choices("日本語中文字本文", k=30_000))
        words.encode(text)
        codec.encode(text)
        assert words.held < 1000 and codec.held < 1000 and not words.memo and not codec.memo and not codec.spaced
    few = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) for _ in range(30)]
    for module, own, encode in ((token_files, words, words.encode), (bpe, codec, codec.encode)):
        before, module.MEMO_BYTES = module.MEMO_BYTES, 50_000
        try:
            for text in few:
                encode(text)
                assert own.held < 150_000
        finally:
            module.MEMO_BYTES = before
    assert [codec.encode(t) for t in few] == [bpe.Codec(RANKS, P.PATTERN).encode(t) for t in few]


def test_ranges_of_a_store_equal_the_mapped_file(tmp_path, monkeypatch):
    path = tmp_path / "ids"
    np.arange(1000, dtype="<u2").tofile(path)
    mapped = token_files.Integers(f"file://{path}", "<u2")
    assert mapped.local and mapped.range(10, 20).tolist() == list(range(10, 20))

    class Store:
        type_name = "store"

        def open_input_file(self, name):
            return pafs.LocalFileSystem().open_input_file(name)

    monkeypatch.setattr(token_files, "file_system", lambda uri: (Store(), str(path)))
    assert token_files.Integers("x://ids", "<u2").range(10, 20).tolist() == list(range(10, 20))


def test_memory_of_words_is_bounded(monkeypatch):
    """Also where no text has a space: what is remembered stays within MEMO_BYTES, and ids are those without a memory."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1 << 20)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeéf", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [sep.join(words[k : k + 100]) for k in range(0, len(words), 100) for sep in ("\n", " ")]
    texts += texts[:40]
    one = bpe.Codec(RANKS, P.PATTERN)
    got = [one.encode(t) for t in texts]
    entries = sum(len(d) for name, d in vars(one).items() if name.startswith(("memo", "spaced")))
    assert 0 < entries <= (1 << 20) // bpe.ENTRY_BYTES
    assert got == [b"".join(one._merged(p) for p in one.split(t)) for t in texts]


def test_shared_queue_equals_one_for_each(monkeypatch):
    rng = random.Random(11)
    for trial in range(12):
        ranks = {bytes([b]): b for b in (b"abc" if trial % 2 else b"ab")}  # c may be no token
        for size in (2, 3, 4, 5):
            for _ in range(25):
                ranks.setdefault(bytes(rng.choices(b"abc", k=size)), 1000 - len(ranks) * rng.choice((1, 7)) % 997)
        ranks = {k: i for i, k in enumerate(sorted(ranks, key=lambda k: (len(k) > 1, ranks[k], k)))}
        merger = bpe.Merger(ranks)
        pieces = [bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(400)] + [b"a" * k for k in range(1, 60)] + [b"c"]
        pieces = [p for p in pieces if p not in ranks]
        for positions in (0, 20, 10**9):  # all buckets as arrays, some, none
            monkeypatch.setattr(bpe, "SHARED_POSITIONS", positions)
            got = merger.merge_all(pieces)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [merger.merge(p) for p in pieces]
            assert not merger.buckets and not any(merger.words)


def test_new_pretokens_of_texts_share_a_queue(oracle, monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdeéfst", k=rng.randrange(2, 14))) + rng.choice(("", "", ",", ".\n", "'s", "2")) for _ in range(3000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 3000, 100)] + ["\n".join(words[:500]), "  ".join(words[500:900]), " \x1c" + " \x1c".join(words[:50])]
    want = [oracle.encode_ordinary(t) for t in texts]
    one = bpe.Codec(RANKS, P.PATTERN)
    monkeypatch.setattr(one.merger, "merge", None)  # no pre-token has a queue of its own
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in one.encode_all(texts)] == want
        assert not one.fresh
    odd = [t or "" for t in TEXTS]
    for gathered, memo in ((1, 1 << 20), (2000, 1 << 20), (10**9, 1 << 14), (2000, 1 << 14)):  # with memories that are filled many times too
        monkeypatch.setattr(bpe, "GATHERED", gathered)
        monkeypatch.setattr(bpe, "MEMO_BYTES", memo)
        one = bpe.Codec(RANKS, P.PATTERN)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in one.encode_all(texts + odd)] == want + [oracle.encode_ordinary(t) for t in odd]
