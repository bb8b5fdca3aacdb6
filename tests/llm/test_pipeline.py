import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as cp
from prose_audit.llm import bpe, language_id, mixing

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    count = docs.count()
    first = cp.detect_language(spark, docs, SMALL)
    assert first.columns == cp.COLUMNS and first.count() > 0.97 * count
    second = cp.near_dedup(spark, first, SMALL)
    assert second.columns == cp.COLUMNS
    texts = [r.text for r in second.collect()]
    assert len(texts) == len({" ".join(t.lower().split()) for t in texts}) <= first.count()
    third = cp.mix_sources(spark, second, SMALL)
    assert third.columns == cp.COLUMNS
    words = {r.source: r.n for r in second.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(words.items()), "source string, size long")).collect()}
    most = {r.source: r.n for r in second.groupBy("source").agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    got = {r.source: r.n for r in third.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    for s in words:
        assert abs(got.get(s, 0) - target[s]) <= most[s] / 2 + 1
    copies = third.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2
    fourth = cp.encode_tokens(spark, third, SMALL)
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = {r.doc_id: r.text for r in second.collect()}
    for r in fourth.collect():
        ids = own.encode(text[r.doc_id])
        assert np.array(r.token_ids, "<u4").tobytes() == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "ab cd", None, "a", 5), (3, "12 34", "en", "b", 5), (4, "ab cd", "en", None, 5), (4, "ab cd", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("document", F.lit("x"))
    for part in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            part = stage(spark, part, SMALL)
            part.count()
    kept = cp.near_dedup(spark, docs, SMALL).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (False, 3), (False, 4)]
    assert len(mixing.mix_rows(docs).columns) == len(docs.columns)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()))
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !!", None), (-4, "x" * 300_000, None), (None, "the and of", None), (None, "the and of", None)], docs.schema)
    rows = language_id.identify(docs.union(odd).withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in rows if r.lang and r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (-1, -2, -3):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id is None}) == 1
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.limit(5), language_id.train(docs.limit(0))).collect()} == {"und"}


def test_tables_equal_the_plain_network():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], 3)
    x = rng.integers(0, 256, (50, language_id.WINDOW)).astype(np.uint8)
    hidden = np.concatenate([np.maximum((net._spread(x, w) @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(1), 0) for w in language_id.WIDTHS], 1)
    logits = hidden @ net.p["out"] + net.p["bias"]
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.abs(language_id.log_probabilities(net.tables(), x) - want).max() < 0.01


def test_gradients():
    net = language_id.Network(["a", "b"], 4)
    rng = random.Random(2)
    x = np.array([[rng.randrange(256) for _ in range(language_id.WINDOW)] for _ in range(6)], np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        hidden = np.concatenate([np.maximum((net._spread(x, w) @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(1), 0) for w in language_id.WIDTHS], 1)
        logits = hidden @ net.p["out"] + net.p["bias"]
        return -(logits - np.log(np.exp(logits).sum(1, keepdims=True)))[np.arange(6), y].mean()

    grad = net._gradients(x, y)
    for k, v in net.p.items():
        i = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        v[i] += 1e-6
        up = loss()
        v[i] -= 2e-6
        down = loss()
        v[i] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-4 * max(1, abs(grad[k][i]))
