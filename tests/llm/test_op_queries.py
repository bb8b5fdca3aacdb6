"""The registered queries over the smallest tables, against plain computations of their contracts."""

import base64
import hashlib
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers as P
from prose_audit.llm import queries as Q

sys.path.insert(0, os.path.dirname(__file__))
import test_html  # noqa: E402
import test_simhash  # noqa: E402
import test_url_filter  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def pages():
    return duckdb.connect().execute(f"SELECT page_id, url, coalesce(html, '') FROM '{SMALL}/pages.parquet' ORDER BY page_id").fetchall()


def run(spark, name, key="doc_id"):
    rows = Q.QUERIES[name](spark, SMALL).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, documents):
    got = run(spark, "op1_language_id")
    held = [(got[d].lang_pred == lang) for d, _, lang in documents if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.95
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _, _ in documents)


def test_op2(spark, documents):
    got = run(spark, "op2_media_jpeg")
    for d, text, _ in documents:
        data = text.encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op3(spark, pages):
    got = run(spark, "op3_warc", "page_id")
    first = {}
    for p, _, html in pages:
        first.setdefault(html, p)
    for p, _, html in pages:
        data, r = html.encode(), got[p]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == p else ("revisit", first[html]))


def test_op4(spark, documents):
    got, at = run(spark, "op4_token_files"), 0
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for d, text, _ in documents:
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op5(spark, pages):
    got = run(spark, "op5_url_filter", "page_id")
    for p, url, _ in pages:
        host, path, rule, verdict = test_url_filter.brute_rule(url)
        assert (got[p].host, got[p].path, got[p].rule) == (host, path, rule) and got[p].verdict in ([verdict] if verdict else ["allow", "block"])


def test_op6(spark, documents):
    got = run(spark, "op6_simhash")
    fp = {d: test_simhash.brute_fingerprint(t, 3) for d, t, _ in documents}
    want = test_simhash.brute_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_op7(spark, documents):
    got = run(spark, "op7_imatch")
    order = sorted(documents, reverse=True)
    text = {d: t for d, t, _ in documents}
    for (d, t, _), (_, other, _) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    by_text = {}
    for d, r in got.items():
        assert by_text.setdefault(text[d], r.fingerprint) == r.fingerprint
    nearer = [r.near_edited > r.near_next for d, r in got.items() if len(text[d]) > 300]
    assert sum(nearer) / len(nearer) > 0.9


def test_op8(spark, documents):
    got = run(spark, "op8_byte_bpe")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, text, _ in documents:
        ids = own.encode_ordinary(text)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op9(spark, documents):
    got = run(spark, "op9_mixing")
    for d, text, _ in documents:
        assert got[d].size == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and 0 <= got[d].taken <= 2 * got[d].size


def test_op10(spark, pages):
    got = run(spark, "op10_html_text", "page_id")
    for p, url, html in pages:
        want = test_html.plain(html)
        assert (got[p].url, got[p].text, got[p].n_chars) == (url, want, len(want))
