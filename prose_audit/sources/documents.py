"""Documents from files and tables, their blocks, and results to files."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import pieces
from ..functions.patterns import WS

ACCEPTED = ("docx", "md", "markdown", "txt")
#: Bytes that a part of a docx may unpack to.
MOST_BYTES = 64 << 20
BLOCK = "struct<level:int,runs:array<struct<text:string,bold:boolean>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route_files(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files that can be read, and the others with a reason."""
    ext = extension(F.col(path))
    reason = F.when(ext == "doc", "The old .doc format isn't read; save it as .docx").otherwise("Not a text, Markdown or docx file")
    return files.filter(ext.isin(*ACCEPTED)), files.filter(~ext.isin(*ACCEPTED)).withColumn("reason", reason)


def read_documents(spark: SparkSession, path: str, format: str = "text") -> DataFrame:
    """``text``: each file one document (path, text); ``parquet``, ``json``, ``orc``: a table as it is."""
    if format == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return spark.read.format(format).load(path)


_PARAGRAPH, _STYLE, _PIECE = re.compile(r"<w:p(?:\s[^>]*)?(?<!/)>.*?</w:p>", re.S), re.compile(r'<w:pStyle w:val="[Hh]eading ?(\d)"'), re.compile(r"<w:t(?: [^>]*)?>(.*?)</w:t>|<w:(tab)\b[^>]*/>|<w:(br)\b[^>]*/>", re.S)
_PROPERTIES = {
    "total_time": ("docProps/app.xml", "TotalTime"), "words": ("docProps/app.xml", "Words"), "application": ("docProps/app.xml", "Application"), "company": ("docProps/app.xml", "Company"),
    "creator": ("docProps/core.xml", "dc:creator"), "last_modified_by": ("docProps/core.xml", "cp:lastModifiedBy"), "created": ("docProps/core.xml", "dcterms:created"),
    "modified": ("docProps/core.xml", "dcterms:modified"), "revision": ("docProps/core.xml", "cp:revision"),
}


def _part(archive: zipfile.ZipFile, name: str) -> str:
    if name not in archive.namelist():
        return ""
    with archive.open(name) as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{name} is over {MOST_BYTES} bytes")
    return data.decode("utf-8", "replace")


def docx_text(content: bytes) -> str:
    """Paragraphs joined by blank lines; headings of level n begin with n number signs, three at most."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        xml = _part(archive, "word/document.xml")
    out = []
    for p in _PARAGRAPH.findall(xml):
        text = "".join(unescape(t, {"&quot;": '"', "&apos;": "'"}) if not (tab or br) else " " if tab else "\n" for t, tab, br in _PIECE.findall(p)).strip()
        if text:
            level = _STYLE.search(p)
            out.append("#" * min(3, int(level[1])) + " " + text if level and level[1] != "0" else text)
    return "\n\n".join(out)


def read_docx(files: DataFrame) -> DataFrame:
    """``files(path, content)``, as Spark's binaryFile gives them → path, text, error (of files that aren't docx)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, docx_text(bytes(content)), None))
                except (zipfile.BadZipFile, ValueError, TypeError) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def docx_provenance(files: DataFrame) -> DataFrame:
    """path and the properties that a docx says of itself. A table of its own: no score reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                row = {"path": path} | dict.fromkeys(_PROPERTIES)
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        for key, (name, tag) in _PROPERTIES.items():
                            m = re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", _part(archive, name), re.S)
                            row[key] = unescape(m[1]) if m else None
                except (zipfile.BadZipFile, ValueError, TypeError):
                    pass
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", *_PROPERTIES])

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{k} string" for k in _PROPERTIES))


def parse_blocks(text: Column) -> Column:
    """array<struct<level, runs<text, bold>>>: blocks between blank lines, headings clamped to level 3, bold runs."""

    def block(raw: Column) -> Column:
        hashes = F.regexp_extract(raw, rf"\A(#{{1,6}}){WS}+", 1)
        body = F.regexp_replace(F.regexp_replace(raw, rf"\A#{{1,6}}{WS}+", ""), r"\n", " ")
        pieces = F.regexp_extract_all(body, F.lit(r"\*\*[^*]+\*\*|(?:(?!\*\*[^*]+\*\*).)+"), F.lit(0))
        bold = r"\A\*\*[^*]+\*\*\z"
        runs = F.transform(pieces, lambda p: F.struct(F.when(p.rlike(bold), F.regexp_replace(p, r"\A\*\*|\*\*\z", "")).otherwise(p).alias("text"), p.rlike(bold).alias("bold")))
        return F.struct(F.least(F.lit(3), F.length(hashes)).cast("int").alias("level"), runs.alias("runs"))

    parts = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), rf"\n{WS}*\n"), X.strip)
    return F.transform(F.filter(parts, lambda p: p != ""), block)


def to_plain_text(blocks: Column, *, shout: bool = False) -> Column:
    """Blocks without markup, between blank lines; ``shout`` puts headings in capitals, as text files have them."""

    def plain(b: Column) -> Column:
        text = F.array_join(F.transform(b["runs"], lambda r: r["text"]), "")
        return F.when((b["level"] > 0) & F.lit(shout), F.upper(text)).otherwise(text)

    return F.array_join(F.transform(blocks, plain), "\n\n")


def normalize_for_match(text: Column) -> Column:
    """struct<norm, offsets>: NFC, white space runs as one space, straight quotes; with the offset in the original of
    every character.

    In a composed text every character but white space stays one, so offsets are those of what is kept; other texts are
    composed piece by piece."""
    quotes = str.maketrans("‘’‚‛“”„‟", "''''\"\"\"\"")
    space = re.compile(f"{WS}+")
    blanks = np.array([c for c in range(0x10000) if space.match(chr(c))], np.uint32)

    def one(t: str) -> dict:
        if unicodedata.is_normalized("NFC", t):
            blank = np.isin(np.frombuffer(t.encode("utf-32-le"), np.uint32), blanks)
            return {"norm": space.sub(" ", t).translate(quotes), "offsets": np.flatnonzero(~(blank & np.r_[False, blank[:-1]])).astype(np.int32)}
        norm, offsets, i = [], [], 0
        while i < len(t):
            m = space.match(t, i)
            if m:
                norm.append(" ")
                offsets.append(i)
                i = m.end()
                continue
            j = i + 1
            while j < len(t) and unicodedata.combining(t[j]):
                j += 1
            for c in unicodedata.normalize("NFC", t[i:j]).translate(quotes):
                norm.append(c)
                offsets.append(i)
            i = j
        return {"norm": "".join(norm), "offsets": np.array(offsets, np.int32)}

    @F.pandas_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame([one(t or "") for t in batch], columns=["norm", "offsets"])

    return run(text)


def truncate_long(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """``docs`` with texts of ``most`` characters at most, and ``truncated``."""
    return docs.withColumn("truncated", F.coalesce(F.length("text") > most, F.lit(False))).withColumn("text", F.substring("text", 1, most))


def language_gate(docs: DataFrame, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """Documents in the language, and the others with a reason."""
    same = F.coalesce(F.col("lang") == lang, F.lit(False))
    reason = F.concat(F.lit("Language is "), F.coalesce("lang", F.lit("unknown")), F.lit(f", not {lang}"))
    return docs.filter(same), docs.filter(~same).withColumn("reason", reason)


def short_text_gate(docs: DataFrame, guard: int = 400, least: int = 150) -> DataFrame:
    """``docs`` with n_words and ``length_guard``: insufficient, short or null."""
    rows = docs.withColumn("n_words", X.word_count(F.coalesce("text", F.lit(""))))
    return rows.withColumn("length_guard", F.when(F.col("n_words") < least, "insufficient").when(F.col("n_words") < guard, "short"))


def write_results(results: DataFrame, path: str, *, by: list[str] | None = None, format: str = "parquet") -> None:
    """A table of results, in folders by the columns ``by``; format text wants one string column."""
    writer = results.write.mode("errorifexists").format(format)
    (writer.partitionBy(*by) if by else writer).save(path)


