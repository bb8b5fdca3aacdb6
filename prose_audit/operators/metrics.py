"""Document metrics: structure, wording, specificity. One row per document, in the row itself where arrays
can say it; only sections use a window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import AFTER_WORD, BEFORE_WORD, WS
from ..functions.phrases import PhraseIndex
from ..sources.sinks import shared_folder

TOKEN = "[A-Za-z][A-Za-z'-]*"
#: Word lists of ours, as defaults; every one is a parameter.
TRANSITIONS = ["however", "moreover", "furthermore", "additionally", "also", "therefore", "thus", "consequently", "finally", "overall", "meanwhile", "similarly", "instead", "indeed"]
HEDGES = ["may", "might", "could", "perhaps", "possibly", "likely", "arguably", "somewhat", "generally", "often", "typically", "seems", "appears", "relatively"]
STOCK = ["at its core", "in today's world", "plays a crucial role", "it is important", "when it comes to", "a testament to", "the power of", "in the world of"]
AUTHORITY = ["studies show", "experts agree", "research suggests", "it is widely accepted", "research shows", "experts say"]
SUMMARY_OPENERS = ["in conclusion", "in summary", "to sum up", "overall", "ultimately", "in short", "to conclude"]


def alternatives(phrases: list[str]) -> str:
    return rf"{BEFORE_WORD}(?:{'|'.join(re.escape(p) for p in phrases)}){AFTER_WORD}"


def per(count: Column, n: Column, unit: float) -> Column:
    return F.when(n > 0, count * unit / n).otherwise(0.0)


def sentence_metrics(lengths: Column) -> Column:
    """struct of mean, population standard deviation, coefficient of variation, extremes, share under 8 words and
    mean step between neighbours relative to the mean, of an array of sentence lengths."""

    def stats(a: Column) -> Column:
        n = F.size(a)
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        mean = total / n

        def spread(m: Column) -> Column:
            var = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), n)
            steps = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(x - y))
            step = F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1)).otherwise(0.0)
            return F.struct(
                F.coalesce(m, F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(var), F.lit(0.0)).alias("stdev"), F.when(m > 0, F.sqrt(var) / m).otherwise(0.0).alias("cv"),
                F.coalesce(F.array_min(a), F.lit(0)).alias("least"), F.coalesce(F.array_max(a), F.lit(0)).alias("most"),
                F.when(n > 0, F.size(F.filter(a, lambda x: x < 8)) / n).otherwise(0.0).alias("short_rate"), F.when(m > 0, step / m).otherwise(0.0).alias("burstiness"),
            )

        return X.let(F.when(n > 0, mean), spread)

    return X.let(lengths, stats)


def stdev(a: Column) -> Column:
    """Population standard deviation of an array; 0 for fewer than two values."""

    def inner(v: Column) -> Column:
        n = F.size(v)
        return X.let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n, lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n))

    return F.when(F.size(a) > 1, X.let(a, inner)).otherwise(0.0)


def array_cv(a: Column) -> Column:
    return X.let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda t: F.when(t > 0, stdev(a) * F.size(a) / t).otherwise(0.0))


def opener_repetition(sentences: Column) -> Column:
    """Share of sentences whose first three words open another one too."""

    def share(keys: Column) -> Column:
        n = F.size(keys)
        alone = F.size(F.filter(F.array_distinct(keys), lambda k: F.array_position(keys, k) == n + 1 - F.array_position(F.reverse(keys), k)))
        return F.when(n > 0, (n - alone) / n).otherwise(0.0)

    heads = F.transform(sentences, lambda s: F.slice(X.words(F.lower(s)), 1, 3))
    return X.let(F.transform(F.filter(heads, lambda w: F.size(w) == 3), lambda w: F.array_join(w, " ")), share)


def document_metrics(
    docs: DataFrame, *, sep: str = "\n\n", stock: list[str] = STOCK, transitions: list[str] = TRANSITIONS, hedges: list[str] = HEDGES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``docs(doc_id, text)`` → one row of metrics per document, after the columns ``keep``; an empty or null text has
    zeros. The two metrics of helpers, mattr and authority_claims, cost nothing unless they are selected."""
    t = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", *keep, t.alias("t"), X.sentences(t).alias("s"), X.paragraphs(t, sep).alias("p"))
    base = base.withColumn("n", F.regexp_count("t", F.lit(TOKEN))).withColumn("len", F.transform("s", lambda s: F.regexp_count(s, F.lit(TOKEN))))
    c = F.col

    def count(pattern: str, of: str = "t") -> Column:
        return F.regexp_count(of, F.lit(pattern))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"\A{WS}*(?:[-*+]|[0-9]+[.)]){WS}"))
    bold = F.filter(lines, lambda x: x.rlike(rf"\A{WS}*(?:[-*+]|[0-9]+[.)]){WS}+\*\*[^*]+\*\*{WS}*:|\A{WS}*(?:[-*+]|[0-9]+[.)]){WS}+\*\*[^*]+:\*\*"))
    numerals = F.regexp_extract_all("t", F.lit(r"(?<![\w.,])[0-9]+(?![\w]|[.,][0-9])"), F.lit(0))
    rounded = F.filter(numerals, lambda x: F.substring(x, -1, 1).isin("0", "5"))
    openers = F.transform("p", lambda p: F.lower(F.regexp_extract(p, r"\A[^A-Za-z]*([A-Za-z]+)", 1)))
    dates = r"(?<![\w])(?:(?:19|20)[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2})(?![\w])"
    section_words = F.transform(F.filter(F.split("t", r"(?m)^#{1,6}\s+.*$"), lambda x: X.strip(x) != ""), lambda x: F.regexp_count(x, F.lit(TOKEN)))
    rows = base.withColumn("m", sentence_metrics(c("len"))).withColumn("w", section_words)
    return rows.select(
        "doc_id",
        *keep,
        c("n").alias("words"),
        F.size("s").alias("sentences"),
        F.size("p").alias("paragraphs"),
        *[c(f"m.{k}").alias(v) for k, v in (("mean", "sent_len_mean"), ("stdev", "sent_len_stdev"), ("cv", "sent_len_cv"), ("least", "sent_len_min"), ("most", "sent_len_max"), ("short_rate", "short_sent_rate"), ("burstiness", "burstiness"))],
        F.get("s", F.array_position("len", c("m.least")).cast("int") - 1).alias("shortest"),
        F.get("s", F.array_position("len", c("m.most")).cast("int") - 1).alias("longest"),
        stdev(F.transform("p", lambda p: F.size(X.sentences(p)))).alias("para_len_stdev"),
        array_cv(c("w")).alias("section_len_cv"),
        F.size("w").alias("sections"),
        per(count("(?i)" + alternatives(stock)), c("n"), 1000).alias("stock_density"),
        F.when(F.size("p") > 0, F.size(F.filter(openers, lambda o: o.isin(transitions))) / F.size("p")).otherwise(0.0).alias("transition_open_rate"),
        per(count(rf"(?i){BEFORE_WORD}[a-z]+, [a-z]+,? and [a-z]+{AFTER_WORD}"), c("n"), 1000).alias("tricolon_density"),
        per(count("—"), c("n"), 1000).alias("em_dash_rate"),
        per(count("—[^—.!?\n]+—"), c("n"), 1000).alias("paired_em_dash_rate"),
        per(count("(?i)" + alternatives(hedges)), c("n"), 100).alias("hedge_density"),
        per(count("(?i)" + alternatives(["i", "me", "my", "mine", "we", "us", "our", "ours"])), c("n"), 1000).alias("first_person_rate"),
        per(count("(?i)" + alternatives(["you", "your", "yours"])), c("n"), 1000).alias("second_person_rate"),
        count(rf"(?i){BEFORE_WORD}not (?:just|only|merely)\s[^.!?;]{{1,80}}?[,;]?\s(?:but|it's|it is){AFTER_WORD}").alias("not_just_count"),
        F.when(F.size("s") > 0, F.size(F.filter("s", lambda s: s.rlike(rf"\A(?:While|Although|Though|Not only|Whereas){AFTER_WORD}|, yet ,?"))) / F.size("s")).otherwise(0.0).alias("balanced_clause_rate"),
        closing_restatement(c("p")).alias("closing_restatement"),
        F.when(F.size(lines) > 0, F.size(bold) / F.size(lines)).otherwise(0.0).alias("bold_lead_bullet_rate"),
        X.flesch(c("t"))["grade"].alias("flesch_kincaid"),
        opener_repetition(c("s")).alias("opener_repetition_rate"),
        per(count(r"(?i)(?<=[a-z])['’](?:s|t|re|ve|ll|d|m)(?![a-z])"), c("n"), 1000).alias("contraction_rate"),
        per(F.size(numerals), c("n"), 1000).alias("numeral_density"),
        per(F.size(rounded), c("n"), 1000).alias("round_numeral_density"),
        per(count(dates), c("n"), 1000).alias("date_density"),
        per(count(r"(?<=[a-z0-9,;:)] )[A-Z][A-Za-z'-]*"), c("n"), 1000).alias("capitalized_density"),
        mattr(c("t")).alias("mattr"),
        authority_claims(c("t")).alias("authority_claims"),
    )


def closing_restatement(paragraphs: Column, openers: list[str] = SUMMARY_OPENERS, share: float = 0.6) -> Column:
    """Whether the last of several paragraphs opens like a summary and repeats most of its content words
    (five letters or more) from the ones before."""

    def content(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0)))

    last = F.element_at(paragraphs, -1)
    before = content(F.array_join(F.slice(paragraphs, 1, F.size(paragraphs) - 1), " "))
    own = content(last)
    repeated = F.size(F.array_intersect(own, before)) > share * F.size(own)
    return F.coalesce(F.when(F.size(paragraphs) > 1, last.rlike("(?i)\\A" + alternatives(openers)) & repeated), F.lit(False))


def mattr(text: Column, window: int = 100) -> Column:
    """Mean share of distinct words in every window of ``window`` words (the share in all if there are fewer)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([moving_types(re.findall(TOKEN, (t or "").lower()), window) for t in batch], dtype=float)

    return run(text)


def moving_types(words: list[str], window: int) -> float:
    if len(words) <= window:
        return len(set(words)) / len(words) if words else 0.0
    count: dict[str, int] = {}
    distinct = total = 0
    for i, w in enumerate(words):
        count[w] = count.get(w, 0) + 1
        distinct += count[w] == 1
        if i >= window:
            out = words[i - window]
            count[out] -= 1
            distinct -= count[out] == 0
        if i >= window - 1:
            total += distinct
    return total / window / (len(words) - window + 1)


def authority_claims(text: Column, phrases: list[str] = AUTHORITY, reach: int = 15) -> Column:
    """Claims by an authority with no citation, year or proper noun in the words that follow."""
    claim = re.compile(rf"\b(?:{'|'.join(map(re.escape, phrases))})\b", re.I | re.A)
    backed = re.compile(r"\[\d+\]|\((?:19|20)\d\d\)|\b(?:19|20)\d\d\b|\b[A-Z][a-z]+")

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                n = 0
                for m in claim.finditer(t or ""):
                    n += not backed.search(" ".join(t[m.end() :].split(None, reach)[:reach]))
                out.append(n)
            yield pd.Series(out, dtype="int32")

    return run(text)


def sections(docs: DataFrame, *, window: int = 400, least: int = 1200) -> DataFrame:
    """doc_id, section, n_words, n_sentences of documents over ``least`` words: by heading, or by ``window`` words
    where there are none. A running count over the sentences of a document gives the section."""
    rows = docs.filter(X.word_count(F.col("text")) > least).select("doc_id", F.posexplode(X.sentences(F.coalesce("text", F.lit("")))).alias("sent_idx", "s"))
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    n = X.word_count(F.col("s"))
    rows = rows.withColumn("n", n).withColumn("head", X.is_heading(F.col("s")).cast("int"))
    rows = rows.withColumn("heads", F.sum("head").over(Window.partitionBy("doc_id"))).withColumn("by_head", F.sum("head").over(order))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("section", F.when(F.col("heads") > 0, F.col("by_head")).otherwise(F.floor(before / window)).cast("int"))
    return rows.groupBy("doc_id", "section").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_sentences"))


def irregularities(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, unknown (distinct words not in ``dictionary(word)``), hyphenation (compounds written both ways),
    serial_comma (whether lists have it both ways)."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:-[a-z]+)*"), F.lit(0)))).alias("word"))
    # a stored table, not an aggregate, so that the join can split the rows of a word that every document has
    path = shared_folder(docs.sparkSession, "dictionary")
    dictionary.select(F.lower("word").alias("word")).distinct().write.parquet(path)
    known = docs.sparkSession.read.schema("word string").parquet(path)
    unknown = words.filter(~F.col("word").contains("-")).join(known, "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))
    joined = words.withColumn("plain", F.translate("word", "-", "")).groupBy("doc_id", "plain").agg(F.count_distinct(F.contains("word", F.lit("-"))).alias("ways"))
    mixed = joined.filter("ways > 1").groupBy("doc_id").agg(F.count("*").alias("hyphenation"))
    comma = F.col("text").rlike(r"\w+, \w+, and \w+") & F.col("text").rlike(r"\w+, \w+ and \w+")
    base = docs.select("doc_id", F.coalesce(comma, F.lit(False)).alias("serial_comma"))
    return base.join(unknown, "doc_id", "left").join(mixed, "doc_id", "left").fillna(0, ["unknown", "hyphenation"]).select("doc_id", "unknown", "hyphenation", "serial_comma")


def stock_hits(text: Column, phrases: list[str] = STOCK) -> Column:
    """array<struct<phrase, count, offsets>> of the phrases that a text has, in the order of the list."""

    @F.pandas_udf("array<struct<phrase:string,count:int,offsets:array<int>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PhraseIndex(phrases, curly=False)
        for batch in batches:
            out = []
            for t in batch:
                offsets: dict[int, list[int]] = {}
                for i, start, _ in index.by_phrase(t or ""):
                    offsets.setdefault(i, []).append(start)
                out.append([{"phrase": phrases[i], "count": len(o), "offsets": o} for i, o in offsets.items()])
            yield pd.Series(out)

    return run(text)


def phrase_hits(docs: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """doc_id, phrase, start, end of every place where one of the phrases, MOST_PHRASES at most, stands as words of
    its own. Each text is read once; nothing is shuffled."""

    @F.pandas_udf("array<struct<number:int,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = PhraseIndex(phrases)
        for batch in batches:
            yield pd.Series([[{"number": i, "start": a, "end": b} for i, a, b in index.hits(t or "")] for t in batch])

    rows = docs.select("doc_id", text, F.explode(run(F.col(text))).alias("h"))
    named = rows.select("doc_id", F.col("h.number").alias("number"), "h.start", "h.end")
    lexicon = docs.sparkSession.createDataFrame([(i, p) for i, p in enumerate(phrases)], "number int, phrase string")
    return named.join(lexicon, "number").select("doc_id", "phrase", "start", "end")


def rule_counts(docs: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """doc_id, phrase, n: how often each phrase stands in each document, those that do. The phrases are an array in
    the plan, so documents and rules meet without a join."""
    named = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit("(?i)" + alternatives([p])).alias("pattern")) for p in phrases])
    counts = F.transform(named, lambda r: F.struct(r["phrase"].alias("phrase"), F.regexp_count(F.coalesce(text, F.lit("")), r["pattern"]).alias("n")))
    return docs.select("doc_id", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).select("doc_id", "c.*")


def genres(docs: DataFrame, lexicon: DataFrame, least: float = 5.0) -> DataFrame:
    """doc_id, genre: that of ``lexicon(genre, word)`` with the most words per 1,000, if there are ``least`` or more.

    Words are counted per document before they meet the lexicon."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    total = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).alias("words"))
    hits = counts.join(lexicon.select("genre", F.lower("word").alias("word")).distinct(), "word").groupBy("doc_id", "genre").agg(F.sum("n").alias("n"))
    rated = hits.join(total, "doc_id").withColumn("rate", per(F.col("n"), F.col("words"), 1000)).filter(F.col("rate") >= least)
    best = rated.groupBy("doc_id").agg(F.max_by("genre", F.struct("rate", "genre")).alias("genre"))
    return docs.select("doc_id").join(best, "doc_id", "left")
