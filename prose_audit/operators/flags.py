"""Flags: what only a person should rewrite.

``flag_documents`` looks at whole texts, as the rewrite leaves them. Protected spans are taken out first, so
nothing inside them is flagged and each counts as one word. One helper does that and finds the flag words;
sentences, paragraphs and headings are judged by Column expressions in the row of the document, so nothing
is shuffled or joined. ``review_flags`` does it per paragraph, with offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import pieces
from ..functions.patterns import BENIGN, CONNECTIVE, HEADING, HEADING_LINE, PASSIVE, WS, java
from ..functions.phrases import DisjointSpans, PhraseIndex
from ..sources.rules import Rules
from .rewrite import Vault, change_count, output_text, snippet
from .spans import find_protected, find_sentences

# Kinds of flags, what they say and advise.
WORD_CHOICE = "Word choice"
LONG_SENTENCE = ("Long sentence", "Hard to follow for non native readers", "Split into two or three short sentences, one idea each")
PASSIVE_VOICE = ("Passive voice", "Passive voice hides who does the action", "Rewrite with the actor first: who does what")
SEMICOLON = ("Semicolon", "Semicolons make sentences feel complex", "Split into two sentences, or use a comma with 'and' or 'but'")
LONG_PARAGRAPH = ("Long paragraph", "Dense blocks are hard to scan", "Break into two paragraphs, or pull key items into a short list")
OPENERS = ("Repetitive rhythm", "Uniform sentence openings read as machine written", "Vary the sentence openings in this paragraph")
CONNECTIVES = ("Repetitive rhythm", "Stacked connectives read as machine written", "Remove most of them; short direct sentences rarely need a connective")
HEADINGS = ("Repetitive headings", "Repeated heading patterns look templated", "Rewrite headings so each one states its section's point")
SPECIFICS = "Missing specifics"

#: Claims without a source, an actor or a number: ours to choose, with the reason given in a flag.
SPECIFIC_PATTERNS = [
    (r"\b(?:research|studies|surveys|data|reports?) (?:shows?|suggests?|indicates?|finds?|proves?)\b", "Research claim without a source"),
    (r"\b(?:experts|analysts|observers|critics|industry leaders) (?:say|agree|believe|argue|predict|recommend)\b", "Authority without a name"),
    (r"\bup to \d+(?:\.\d+)? ?(?:%|percent\b)", "An upper limit without a typical value"),
    (r"\b(?:many|most|countless|numerous|several|some) (?:companies|organizations|businesses|people|users|teams|customers)\b", "Population without a number"),
    (r"\bit is (?:widely|generally|commonly|often) (?:known|accepted|believed|said|recognized)\b", "Attribution to nobody"),
    (r"(?<![\w.])\d+(?:\.\d+)?(?:%| percent\b)(?!(?:(?!\.\s).)*\b(?:according|source|survey|report|study)\b)", "Percentage without a source"),
]

#: What a text in lower case has if the pattern at the same place matches in it.
SPECIFIC_HINTS = [
    ("research", "studies", "surveys", "data", "report"), ("experts", "analysts", "observers", "critics", "industry leaders"), ("up to ",),
    ("companies", "organizations", "businesses", "people", "users", "teams", "customers"), ("it is ",), ("%", " percent"),
]
#: What a sentence in lower case has if it has a passive.
PASSIVE_HINT = re.compile(rf"(?:am|is|are|was|were|been|being|be){WS}")

FLAG = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "excerpt", "found", "reason", "suggestion")]
)
MASKED = T.StructType([T.StructField("masked", T.StringType()), T.StructField("kept", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(FLAG))])


def dim_for_flag_word(reason: str, dim: str | None = None) -> str:
    """The dimension of a flag word: its own, or from its reason."""
    if dim:
        return dim
    low = reason.lower()
    if any(x in low for x in ("connective", "legalese", "abstract", "complex construction", "vague")):
        return "d3"
    return "d1"


def masked_text(text: Column, rules: Rules) -> Column:
    """struct<masked, kept, words>: the text with protected spans as numbers, the spans, the flag words in it."""

    @F.pandas_udf(MASKED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vault, index = Vault(rules.protected), PhraseIndex([r[0] for r in rules.flags])
        for batch in pieces(batches):
            rows: dict[str, list] = {"masked": [], "kept": [], "words": []}
            for text in batch:
                own, kept = vault.take(text or "")
                found = []
                for i, start, end in index.by_phrase(own):
                    excerpt = snippet(own, start, end - start)
                    found.append({"type": WORD_CHOICE, "excerpt": excerpt, "found": own[start:end], "reason": rules.flags[i][1], "suggestion": rules.flags[i][2]})
                rows["masked"].append(own)
                rows["kept"].append(kept)
                rows["words"].append(found)
            yield pd.DataFrame(rows)

    return run(text)


def restored(text: Column, kept: Column) -> Column:
    """Protected spans back in the place of their numbers; twice, as a term can lie within another span."""

    def once(x: Column) -> Column:
        numbered = F.arrays_zip(F.transform(kept, lambda s, i: i).alias("i"), kept.alias("s"))
        return F.aggregate(numbered, x, lambda out, k: F.replace(out, F.concat(F.lit("\0"), k["i"].cast("string"), F.lit("\0")), k["s"]))

    return F.when((F.size(kept) == 0) | ~F.contains(text, F.lit("\0")), text).otherwise(once(once(text)))


def _flag(kind: tuple[str, str, str], excerpt: Column, found: Column) -> Column:
    values = {"type": F.lit(kind[0]), "excerpt": excerpt, "found": found, "reason": F.lit(kind[1]), "suggestion": F.lit(kind[2])}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _where(condition: Column, flag: Column) -> Column:
    return F.when(condition, F.array(flag)).otherwise(F.array().cast(T.ArrayType(FLAG)))


def _repeated(keys: Column, least: int = 3) -> Column:
    """array<struct<key, n>> of the strings that come up ``least`` times, in order of first appearance."""
    counted = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).alias("n")))
    return F.filter(counted, lambda x: x["n"] >= least)


def passive_match(sentence: Column) -> Column:
    """The first passive of a sentence, or the empty string: benign states only if an agent follows."""
    found = F.regexp_extract(sentence, "(?i)" + java(PASSIVE), 0)
    by = F.regexp_extract(sentence, "(?i)" + java(PASSIVE), 3)
    return F.when((found != "") & (~found.rlike("(?i)" + java(BENIGN)) | (by != "")), found).otherwise("")


def sentence_flags(sentence: Column, settings: dict) -> Column:
    """Flags of one sentence; headings have none."""
    n, shown = X.word_count(sentence), X.cut(sentence, 160)
    most = int(settings.get("maxSentenceWords") or 28)
    parts = [_where(n > most, _flag(LONG_SENTENCE, shown, F.concat(n.cast("string"), F.lit(" words"))))]
    if settings.get("flagPassiveVoice"):
        parts.append(X.let(passive_match(sentence), lambda p: _where(p != "", _flag(PASSIVE_VOICE, shown, p))))
    if settings.get("flagSemicolons"):
        parts.append(_where(F.contains(sentence, F.lit(";")), _flag(SEMICOLON, shown, F.lit(";"))))
    return F.when(sentence.rlike(HEADING), F.array().cast(T.ArrayType(FLAG))).otherwise(F.concat(*parts))


def paragraph_flags(paragraph: Column, settings: dict) -> Column:
    """Long paragraphs, and sentences of a paragraph that open with the same two words."""
    most = int(settings.get("maxParagraphSentences") or 6)
    shown = F.concat(X.replace(F.substring(paragraph, 1, 120), f"{WS}+", " "), F.lit("…"))

    def judged(parts: Column) -> Column:
        long = _where(F.size(parts) > most, _flag(LONG_PARAGRAPH, shown, F.concat(F.size(parts).cast("string"), F.lit(" sentences"))))
        heads = F.transform(parts, lambda s: F.slice(X.words(s), 1, 2))
        pairs = F.transform(F.filter(heads, lambda w: F.size(w) == 2), lambda w: F.lower(F.array_join(w, " ")))
        found = F.transform(_repeated(pairs), lambda r: _flag(OPENERS, shown, F.concat(r["n"].cast("string"), F.lit(' sentences start with "'), r["key"], F.lit('"'))))
        return F.concat(long, found)

    return F.when(paragraph.rlike(rf"\A{WS}*#"), F.array().cast(T.ArrayType(FLAG))).otherwise(X.let(X.sentences(paragraph), judged))


def connective_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CONNECTIVE))


def document_flags(text: Column) -> Column:
    """Stacked connectives, and headings that open with the same word."""
    n = connective_count(text)
    stacked = _where(n >= 3, _flag(CONNECTIVES, F.concat(n.cast("string"), F.lit(" sentences start with a connective (Also / However / So)")), F.concat(n.cast("string"), F.lit(" occurrences"))))
    lines = F.regexp_extract_all(text, F.lit("(?d)" + HEADING_LINE), F.lit(0))
    first = F.transform(lines, lambda h: F.lower(F.coalesce(F.get(X.words(X.replace(h, rf"\A#+{WS}+", "")), F.lit(0)), F.lit(""))))
    repeated = _repeated(F.filter(first, lambda w: w != ""))
    return F.concat(stacked, F.transform(repeated, lambda r: _flag(HEADINGS, F.concat(r["n"].cast("string"), F.lit(' headings start with "'), r["key"], F.lit('"')), r["key"])))


def flag_documents(docs: DataFrame, rules: Rules, *, text: str = "text", para_sep: str = rf"\n{WS}*\n") -> DataFrame:
    """``docs`` with ``flags``: array<struct<type, excerpt, found, reason, suggestion>>.

    Null texts are empty. Paragraphs are told apart by empty lines, or by ``para_sep``, a regular expression.
    """
    own = docs.withColumn("__m", masked_text(F.col(text), rules))
    masked = F.col("__m.masked")
    by_sentence = F.flatten(F.transform(X.sentences(masked), lambda s: sentence_flags(s, rules.settings)))
    by_paragraph = F.flatten(F.transform(F.split(masked, para_sep), lambda p: paragraph_flags(p, rules.settings)))
    flags = F.concat(F.col("__m.words"), by_sentence, by_paragraph, document_flags(masked))
    return own.withColumn("flags", _with_kept(flags, F.col("__m.kept"))).drop("__m")


def _with_kept(flags: Column, kept: Column) -> Column:
    back = F.transform(
        flags, lambda f: F.struct(f["type"].alias("type"), restored(f["excerpt"], kept).alias("excerpt"), restored(f["found"], kept).alias("found"), f["reason"].alias("reason"), f["suggestion"].alias("suggestion"))
    )
    return F.when(F.size(kept) > 0, back).otherwise(flags)


def flag_words(docs: DataFrame, rules: Rules, *, text: str = "text") -> DataFrame:
    """``docs`` with ``flags``: of those that ``flag_documents`` gives the flag words, without a look at sentences and paragraphs."""
    own = docs.withColumn("__m", masked_text(F.col(text), rules))
    return own.withColumn("flags", _with_kept(F.col("__m.words"), F.col("__m.kept"))).drop("__m")


def flag_rows(flagged: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, flag_seq and the flag's fields."""
    return flagged.select("doc_id", *keep, F.posexplode("flags").alias("flag_seq", "f")).select("doc_id", *keep, "flag_seq", "f.*")


def flags_by_type(flagged: DataFrame, by: str) -> DataFrame:
    """Flags per type and value of ``by``, and in all (null); ``docs`` are distinct documents in both."""
    own = flag_rows(flagged, by).groupBy(by, "type", "doc_id").agg(F.count("*").alias("n"))
    return own.groupingSets([[by, "type"], ["type"]], by, "type").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"))


def flags_by_dimension(flags: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """``flags(doc_id, dim)`` and ``docs(doc_id, by)`` → by, dim, n, docs and whether a row is over all values of
    ``by`` or of dim. Flags are counted per document before they meet the documents."""
    own = flags.groupBy("doc_id", "dim").agg(F.count("*").alias("n")).join(docs.select("doc_id", by), "doc_id")
    out = own.cube(by, "dim").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"), F.grouping(by).alias("all_groups"), F.grouping("dim").alias("all_dims"))
    return out.select(by, "dim", "n", "docs", F.col("all_groups").cast("int").alias("all_groups"), F.col("all_dims").cast("int").alias("all_dims"))


def flag_rule_usage(flagged: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Of every flag word: find, hits, docs; 0 where it never fired. Hits are counted in the row of a document first."""
    keys = F.transform(F.filter("flags", lambda f: f["type"] == WORD_CHOICE), lambda f: F.lower(F.translate(f["found"], "’", "'")))
    own = flagged.select(F.explode(_repeated(keys, 1)).alias("k")).groupBy(F.col("k.key").alias("key")).agg(F.sum("k.n").alias("hits"), F.count("*").alias("docs"))
    rules = rules_table.filter(F.col("list") == "flagWords").select("find", F.lower(F.translate("find", "’", "'")).alias("key"))
    return rules.join(own, "key", "left").select("find", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("docs", F.lit(0)).alias("docs"))


def document_statistics(rewritten: DataFrame, rules: Rules, *, sep: str = "\n\n", para_sep: str = rf"\n{WS}*\n") -> DataFrame:
    """doc_id, before and after (readability), change_count, flag_count (flags left in the output), words_saved."""
    flagged = flag_documents(rewritten.withColumn("__output", output_text(sep)), rules, text="__output", para_sep=para_sep)
    both = flagged.select("doc_id", X.flesch(output_text(sep, "original")).alias("before"), X.flesch(F.col("__output")).alias("after"), change_count().alias("change_count"), F.size("flags").alias("flag_count"))
    return both.withColumn("words_saved", F.col("before.words") - F.col("after.words"))


# ---------------------------------------------------------------------------------------------------
# review: flags of a paragraph with offsets

REVIEW = T.StructType(
    [
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("type", "dim", "found", "reason", "suggestion", "kind", "replace", "excerpt")],
    ]
)


class Reviewer:
    """Flags of one paragraph, by the rules of one set. An earlier flag keeps its range; advice on a whole
    sentence or paragraph claims none. Without ``excerpts`` they are null."""

    def __init__(self, rules: Rules, *, excerpts: bool = True) -> None:
        self.rules, self.words, self.excerpts = rules, PhraseIndex([r[0] for r in rules.flags]), excerpts
        self.passive, self.benign = re.compile(PASSIVE, re.A | re.I), re.compile(BENIGN, re.A | re.I)
        self.specifics = [(re.compile(p, re.A | re.I), reason, hints) for (p, reason), hints in zip(SPECIFIC_PATTERNS, SPECIFIC_HINTS, strict=True)]
        self.heading, self.word = re.compile(HEADING), re.compile("[A-Za-z0-9'’-]+")

    def review(self, text: str) -> list[tuple]:
        settings, out = self.rules.settings, []
        claimed = DisjointSpans([(a, b) for a, b, _ in find_protected(text, self.rules.protected)])
        sentences = find_sentences(text)

        def span(kind: tuple | str, dim: str, a: int, b: int, reason: str, advice: str, how: str, by: str | None = None, found: str | None = None) -> None:
            if how != "advice-span" and not claimed.add(a, b):
                return
            excerpt = None if not self.excerpts else snippet(text, a, b - a) if how != "advice-span" else text[a:b][:160] + "…" * (b - a > 160)
            out.append((a, b, kind, dim, text[a:b] if found is None else found, reason, advice, how, by, excerpt))

        for i, a, b in self.words.by_phrase(text):
            _, reason, advice, dim, alternatives = self.rules.flags[i]
            span(WORD_CHOICE, dim_for_flag_word(reason, dim), a, b, reason, advice, "swap" if alternatives else "advice", (alternatives or [None])[0])
        low = text.lower()
        for pattern, reason, hints in self.specifics:
            for m in pattern.finditer(text) if any(h in low for h in hints) else ():
                span(SPECIFICS, "d4", *m.span(), reason, "Name the source, the people or the number", "advice")
        heading = text.lstrip().startswith("#")
        openers: dict[str, int] = {}
        for a, b, s in sentences:
            words = self.word.findall(s)
            if not heading and len(words) > 1:
                key = f"{words[0]} {words[1]}".lower()
                openers[key] = openers.get(key, 0) + 1
            if s[0] == "#" and self.heading.match(s):
                continue
            n = len(words)
            if n > int(settings.get("maxSentenceWords") or 28):
                span(LONG_SENTENCE[0], "d2", a, b, *LONG_SENTENCE[1:], "advice-span", None, f"{n} words")
            if settings.get("flagPassiveVoice") and PASSIVE_HINT.search(s.lower()) and (m := self.passive.search(s)) and (m[3] or not self.benign.search(m[0])):
                span(PASSIVE_VOICE[0], "d3", a + m.start(), a + m.end(), *PASSIVE_VOICE[1:], "advice")
            if ";" in s and settings.get("flagSemicolons"):
                for m in re.finditer(";", s):
                    span(SEMICOLON[0], "d2", a + m.start(), a + m.end(), *SEMICOLON[1:], "advice")
        if not heading and len(sentences) > int(settings.get("maxParagraphSentences") or 6):
            span(LONG_PARAGRAPH[0], "d2", 0, len(text), *LONG_PARAGRAPH[1:], "advice-span", None, f"{len(sentences)} sentences")
        for key, n in openers.items():
            if n >= 3:
                span(OPENERS[0], "d2", 0, len(text), *OPENERS[1:], "advice-span", None, f'{n} sentences start with "{key}"')
        return out


def review_paragraph(text: Column, rules: Rules, *, excerpts: bool = True) -> Column:
    """array<struct> of a paragraph's flags with start, end, dim, kind and replace."""
    names = REVIEW.fieldNames()

    @F.pandas_udf(T.ArrayType(REVIEW))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Reviewer(rules, excerpts=excerpts)
        for batch in pieces(batches):
            yield pd.Series([[dict(zip(names, f)) for f in own.review(t or "")] for t in batch])

    return run(text)


def dimension_counts(paragraphs: Column, rules: Rules) -> Column:
    """struct<d1, d2, d3, d4>: flags of each dimension in the paragraphs (array<string>) of a document, in its row."""
    dims = ("d1", "d2", "d3", "d4")

    @F.pandas_udf(T.StructType([T.StructField(d, T.IntegerType()) for d in dims]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Reviewer(rules, excerpts=False)
        for batch in pieces(batches):
            found = [[f[3] for p in ([] if texts is None else texts) for f in own.review(p or "")] for texts in batch]
            yield pd.DataFrame({d: [x.count(d) for x in found] for d in dims}, dtype="int32")

    return run(paragraphs)


def dimension_counts_of_both(original: Column, output: Column, rules: Rules) -> Column:
    """struct<before, after> of ``dimension_counts``, of paragraphs (array<string>) and of what became of them; a paragraph
    that stayed as it is is looked at once."""
    dims = ("d1", "d2", "d3", "d4")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Reviewer(rules, excerpts=False)

        def found(text: str | None) -> list[str]:
            return [f[3] for f in own.review(text or "")]

        for before, after in batches:
            rows = []
            for a, b in zip(before, after):
                pairs = [(x := found(p), x if p == q else found(q)) for p, q in zip([] if a is None else a, [] if b is None else b)]
                rows.append([sum(pair[side].count(d) for pair in pairs) for side in (0, 1) for d in dims])
            yield pd.Series(rows)

    def sides(n: Column) -> Column:
        return F.struct(*[F.struct(*[F.get(n, F.lit(4 * k + i)).alias(d) for i, d in enumerate(dims)]).alias(side) for k, side in enumerate(("before", "after"))])

    return X.let(run(original, output), sides)


def paragraph_dimensions(text: Column, rules: Rules) -> Column:
    """array<string>: the dimension of each of a paragraph's flags."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Reviewer(rules, excerpts=False)
        for batch in pieces(batches):
            yield pd.Series([[f[3] for f in own.review(t or "")] for t in batch])

    return run(text)


def review_dimensions(paragraphs: DataFrame, rules: Rules, *, documents: DataFrame | None = None) -> DataFrame:
    """doc_id and dim of all that ``review_flags`` gives, for scores, which need no more of a flag."""
    rows = paragraphs.select("doc_id", F.explode(paragraph_dimensions(F.col("output"), rules)).alias("dim"))
    if documents is None:
        return rows
    return rows.unionByName(documents.select("doc_id", F.explode(F.transform(document_flags(F.col("text")), lambda f: F.lit("d2"))).alias("dim")))


def review_flags(paragraphs: DataFrame, rules: Rules, *, documents: DataFrame | None = None) -> DataFrame:
    """Flags of ``paragraphs(doc_id, para_idx, output)`` with offsets into the paragraph; with ``documents(doc_id,
    text)`` also those of whole documents, whose para_idx, start and end are null."""
    rows = paragraphs.select("doc_id", "para_idx", F.explode(review_paragraph(F.col("output"), rules)).alias("f")).select("doc_id", "para_idx", "f.*")
    if documents is None:
        return rows
    whole = documents.select("doc_id", F.explode(document_flags(F.col("text"))).alias("f"))
    null = F.lit(None)
    return rows.unionByName(
        whole.select(
            "doc_id", null.cast("int").alias("para_idx"), null.cast("int").alias("start"), null.cast("int").alias("end"), "f.type", F.lit("d2").alias("dim"), "f.found", "f.reason",
            "f.suggestion", F.lit("document").alias("kind"), null.cast("string").alias("replace"), "f.excerpt",
        )
    )
