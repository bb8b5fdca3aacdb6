"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, imatch, language_id, licenses, media, merkle, mixing, negatives, simhash, token_files, url_filter, warc

#: Files of public vocabularies; only their paths are kept here.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPLIT_PATTERN = public_tokenizers.PATTERN
END_ID = 2
#: Rules on urls.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network that learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as baseline JPEG in a media column, read back with digests and features."""
    return media.media_table(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC transactions, read back."""
    return warc.captures(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID files of all documents in doc_id order, read back."""
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID)
    return token_files.read_token_files(manifest, ids=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 3-word shingles and components of fingerprints 2 bits apart at most."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, budget=2)


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts."""
    return imatch.compare_with_edits(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and the bytes that decoding gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, BYTE_RANKS, SPLIT_PATTERN, ids=False).drop("text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights, in the order of their training positions."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding, among all; every 7th has the next label instead of its own."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, and whether documents tampered with still lead to the root."""
    return merkle.check_rows(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_media_jpeg": op2_media_jpeg,
    "op3_warc": op3_warc,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_imatch": op7_imatch,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.MIX_SQL, "op11_license_scan": licenses.SCAN_SQL, "op12_hard_negatives": negatives.MINE_SQL, "op13_merkle": merkle.CHECK_SQL}
