"""Rewriting by a style: every rule as a pass over the text, with a log of every change.

The passes depend on each other (what one rule writes the next one reads), so a paragraph is rewritten by a
helper in Python, in Arrow batches; swaps are found by the words of the text, not tried one by one. Documents are split, rewritten and logged within their row, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import pieces
from ..functions.patterns import EMOJI, PROTECTED, PROTECTED_HINT, WS, literal
from ..functions.phrases import lowered
from ..sources.rules import Rules

# Names of the changes, as the log has them.
CATEGORIES = {"fillerPhrases": "Filler phrase", "hypeSwaps": "Hype and AI wording", "simpleSwaps": "Simpler word", "contractions": "Contraction expanded"}
OPENER, FILLER, DASH, EMOJIS = "Removed filler opener", "Removed filler", "Dash cleanup", "Emoji removal"

# Words that show whether a word that is both noun and verb stands as a verb.
VERB_SIGNS = set(
    (
        "to will would shall should can could may might must cannot let lets help helps allow allows enable enables and or then not never always also "
        "we they you i he she it one who that which"
    ).split()
)
DETERMINERS = set(
    "a an the this that these those no any some our its their his her my your each every another both all more less much many few".split()
)
OBJECT_SIGNS = set("a an the this that these those its our their his her my your all both".split())
ADJECTIVE_ENDINGS = ("al", "ial", "ic", "ical", "ive", "ous", "ful", "less", "able", "ible", "ary", "ent", "ant", "ing", "ed")
MODIFIERS = set(
    "good bad new old great small large high low strong weak robust solid light heavy fast slow full real main key core test unit eval build release "
    "smoke load stress prod staging financial market competitive".split()
)

CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "before", "after", "context")])
PARAGRAPH = T.StructType([T.StructField("original", T.StringType()), T.StructField("output", T.StringType()), T.StructField("changes", T.ArrayType(CHANGE))])

A, AI = re.ASCII, re.ASCII | re.IGNORECASE
Change = tuple[str, str, str, str]


def snippet(text: str, start: int, length: int) -> str:
    """32 characters on both sides of a span, white space collapsed."""
    a, b = max(0, start - 32), min(len(text), start + length + 32)
    return ("…" if a else "") + re.sub(f"{WS}+", " ", text[a:b]) + ("…" if b < len(text) else "")


def match_case(source: str, replacement: str) -> str:
    if len(source) > 2 and source.upper() == source:
        return replacement.upper()
    return replacement[:1].upper() + replacement[1:] if source[:1] == source[:1].upper() else replacement


class Vault:
    """Protected spans taken out of a text. Each leaves a number between two NULs, which counts as a word."""

    MARK = re.compile("\0([0-9]+)\0")

    def __init__(self, terms: list[str]) -> None:
        self.patterns = [re.compile(p, A) for _, p in PROTECTED]
        self.patterns += [re.compile(re.escape(t)) for t in sorted(filter(None, terms), key=len, reverse=True)]
        self.hint = re.compile("|".join([PROTECTED_HINT, *(re.escape(t) for t in terms if t)]))

    def take(self, text: str) -> tuple[str, list[str]]:
        kept: list[str] = []

        def put(m: re.Match) -> str:
            kept.append(m[0])
            return f"\0{len(kept) - 1}\0"

        if self.hint.search(text):
            for pattern in self.patterns:
                text = pattern.sub(put, text)
        return text, kept

    def give_back(self, text: str, kept: list[str]) -> str:
        """Spans within spans come back too, so this goes on until no number of the vault is left."""
        while kept and "\0" in text:
            new = self.MARK.sub(lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)
            if new == text:
                break
            text = new
        return text


class VerbGuard:
    """Whether a word stands as a verb, from the words around it. In doubt it doesn't.

    A sign right before it decides; at the start of a sentence an object must follow; elsewhere nothing before it may
    make it a noun: a determiner among three words, or a modifier next to it.
    """

    # fixed values: how far the guard looks, how many words before, and what a sentence begins after
    LEFT, RIGHT, WORDS_BEFORE = 60, 30, 3
    NEXT_BEFORE, NEXT_AFTER = re.compile(rf"(\w+){WS}+\Z", AI), re.compile(rf"{WS}+(\w+)", AI)
    START = re.compile(rf"(?:\A|[.!?;:]{WS}+|[\n\r]{WS}*|[\"'(\[]{WS}*)\Z")
    WORDS = re.compile(r"[\w'-]+", A)

    def __call__(self, text: str, start: int, end: int) -> bool:
        left = text[max(0, start - self.LEFT) : start]
        before, after = self.NEXT_BEFORE.search(left), self.NEXT_AFTER.match(text, end, end + self.RIGHT)
        signed = before is not None and before[1].lower() in VERB_SIGNS
        if self.START.search(left):
            return signed or after is not None and after[1].lower() in OBJECT_SIGNS
        words = [w.lower() for w in self.WORDS.findall(left)[-self.WORDS_BEFORE :]]
        return signed or not (DETERMINERS.intersection(words) or self._modifies(words[-1] if words else ""))

    @staticmethod
    def _modifies(word: str) -> bool:
        return word in MODIFIERS or len(word) > 3 and word.endswith(ADJECTIVE_ENDINGS)


_SPACES_BEFORE, _SPACE_BEFORE = re.compile(" +([.,;:!?])"), re.compile(" ([.,;:!?])")
_COMMAS, _COMMA_BEFORE = re.compile(rf",{WS}*,"), re.compile(rf",{WS}*([.,;:!?])")
_RUN, _LINE_END, _WORDS = re.compile(" {2,}"), re.compile(" +\n"), re.compile("[a-z0-9_]+")


def _spaced(text: str) -> bool:
    """Whether there is a space before punctuation."""
    return any(x in text for x in (" .", " ,", " ;", " :", " !", " ?"))


class Rewriter:
    """All passes of one rule set, compiled. A pass is made over texts that hold what it looks for."""

    DASHES = [
        (re.compile(rf"([0-9]){WS}*[–—]{WS}*([0-9])"), lambda m: (m[0], f"{m[1]} to {m[2]}", f"{m[1]} to {m[2]}")),
        (re.compile(rf"{WS}*[—–]{WS}*"), lambda m: (re.sub(rf"\A{WS}+|{WS}+\Z", "", m[0]) or "—", ",", ", ")),
        (re.compile(rf"((?!{WS}).){WS}*--{WS}*((?!{WS}).)", re.S), lambda m: ("--", ",", f"{m[1]}, {m[2]}")),
    ]

    def __init__(self, rules: Rules) -> None:
        self.settings = rules.settings
        self.vault, self.is_verb = Vault(rules.protected), VerbGuard()
        self.openers = [(p, self._first(p), self._plain(p), re.compile(rf"((?:^|[.!?:]{WS}+|\n{WS}*))" + re.escape(p).replace("'", "['’]") + rf"{WS}+([a-zA-Z\0])", re.M)) for p in rules.deletes.get("sentenceStartDeletes", []) if p]
        self.fillers = [(self._first(p), self._plain(p), re.compile(rf"(,{WS}*)?" + literal(p) + rf"({WS}*,)?", AI)) for p in rules.deletes.get("midSentenceDeletes", []) if p]
        self.swaps = []
        for name, category in CATEGORIES.items():
            if name == "contractions" and not rules.settings.get("expandContractions"):
                continue
            # longest first: phrases before the words in them
            ordered = sorted((r for r in rules.swaps.get(name, []) if r[0]), key=lambda r: -len(r[0]))
            self.swaps += [(category, self._first(find), re.compile(literal(find), AI), to, verb) for find, to, verb in ordered]

        self.by_first: dict[str, list[tuple[int, str]]] = {}
        finds = [self._plain(r[0]) for name in CATEGORIES if name != "contractions" or rules.settings.get("expandContractions") for r in sorted((r for r in rules.swaps.get(name, []) if r[0]), key=lambda r: -len(r[0]))]
        for i, (find, (_, first, *_)) in enumerate(zip(finds, self.swaps, strict=True)):
            self.by_first.setdefault(first, []).append((i, find))

    def _swaps_in(self, text: str) -> list[int]:
        """The swaps, in order, whose phrase the text has: found by its words, not by trying all swaps."""
        low = self._plain(text)
        return sorted(i for run in self._runs(text) for i, find in self.by_first.get(run, ()) if find in low)

    @staticmethod
    def _plain(text: str) -> str:
        """Without case and curly apostrophes, as phrases are looked for."""
        return lowered(text).replace("’", "'")

    @staticmethod
    def _first(phrase: str) -> str:
        """The phrase's first run of word characters: a text without it among its own can't hold the phrase."""
        m = re.match("[a-z0-9_]+", phrase.lower())
        return m[0] if m else ""

    @staticmethod
    def _runs(text: str) -> set[str]:
        return {"", *_WORDS.findall(text.lower())}

    def rewrite(self, text: str) -> tuple[str, list[Change]]:
        """Output and changes of one text."""
        log: list[Change] = []
        text, kept = self.vault.take(text)
        if self.settings.get("removeEmojis"):
            text = self._emojis(text, log)
        if self.settings.get("fixDashes"):
            text = self._dashes(text, log)
        runs, low = self._runs(text), self._plain(text)
        for phrase, first, plain, pattern in self.openers:
            if first in runs and plain in low:
                text = self._pass(text, pattern, log, lambda m: (OPENER, f"{phrase} …", "(removed)", m[1] + m[2].upper()))
                low = self._plain(text)
        for first, phrase, pattern in self.fillers:
            if first in runs and phrase in low:
                text = self._pass(text, pattern, log, lambda m: (FILLER, m[0].strip(), "(removed)", ", " if m[1] and m[2] else " "))
                low = self._plain(text)
        text = _RUN.sub(" ", text) if "  " in text else text
        text = _SPACE_BEFORE.sub(r"\1", text) if _spaced(text) else text
        text = _COMMAS.sub(",", text) if "," in text else text
        todo, at = self._swaps_in(text), -1
        while todo:
            at = heapq.heappop(todo)
            category, _, pattern, to, verb = self.swaps[at]
            n = len(log)
            text = self._pass(text, pattern, log, lambda m: None if verb and not self.is_verb(m.string, m.start(), m.end()) else (category, m[0], match_case(m[0], to), match_case(m[0], to)))
            if len(log) > n:
                todo = [i for i in self._swaps_in(text) if i > at]
        text = _RUN.sub(" ", text) if "  " in text else text
        text = _LINE_END.sub("\n", text) if " \n" in text else text
        return self.vault.give_back(text, kept), [(c, b, a, self.vault.give_back(x, kept)) for c, b, a, x in log]

    def _pass(self, text: str, pattern: re.Pattern, log: list[Change], change) -> str:
        """One rule over the text; ``change`` gives category, before, after and the new words, or None."""

        def sub(m: re.Match) -> str:
            got = change(m)
            if got is None:
                return m[0]
            log.append((*got[:3], snippet(text, m.start(), len(m[0]))))
            return got[3]

        return pattern.sub(sub, text)

    def _emojis(self, text: str, log: list[Change]) -> str:
        text, n = (text, 0) if text.isascii() else re.subn(EMOJI, "", text)
        if n:
            log.append((EMOJIS, f"{n} emoji(s)", "(removed)", ""))
        text = _RUN.sub(" ", text) if "  " in text else text
        return _SPACES_BEFORE.sub(r"\1", text) if _spaced(text) else text

    def _dashes(self, text: str, log: list[Change]) -> str:
        if "–" in text or "—" in text or "--" in text:
            for pattern, new in self.DASHES:
                text = self._pass(text, pattern, log, lambda m: (DASH, *new(m)))
        return _COMMA_BEFORE.sub(r"\1", text) if "," in text else text


def rewritten_batches(batches: Iterator[pd.Series], rules: Rules) -> Iterator[pd.Series]:
    """Batches of lists of paragraphs, rewritten piece by piece: texts, outputs and logs of a whole batch are never held."""
    own = Rewriter(rules)
    names = CHANGE.fieldNames()
    for batch in pieces(batches):
        out = []
        for texts in batch:
            row = []
            for text in () if texts is None else texts:
                new, log = own.rewrite(text)
                row.append({"original": text, "output": new, "changes": [dict(zip(names, c)) for c in log]})
            out.append(row)
        yield pd.Series(out)


def rewrite_paragraphs(paragraphs: Column, rules: Rules) -> Column:
    """array<string> of paragraphs → array<struct<original, output, changes>>."""

    @F.pandas_udf(T.ArrayType(PARAGRAPH))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from rewritten_batches(batches, rules)

    return run(paragraphs)


def rewrite_documents(docs: DataFrame, rules: Rules, *, sep: str = "\n\n", grain: str = "paragraph", text: str = "text") -> DataFrame:
    """``docs`` with ``paragraphs``: array<struct<original, output, changes>>.

    ``grain`` "paragraph" splits at ``sep``; "document" rewrites the text in one piece.
    """
    if grain not in ("paragraph", "document"):
        raise ValueError("grain is paragraph or document")
    parts = X.paragraphs(F.col(text), sep) if grain == "paragraph" else F.array(F.coalesce(text, F.lit("")))
    return docs.withColumn("paragraphs", rewrite_paragraphs(parts, rules))


def output_text(sep: str = "\n\n", of: str = "output") -> Column:
    """The paragraphs' texts joined again."""
    return F.array_join(F.col(f"paragraphs.{of}"), sep)


def paragraph_rows(rewritten: DataFrame) -> DataFrame:
    """doc_id, para_idx, original, output."""
    return rewritten.select("doc_id", F.posexplode("paragraphs").alias("para_idx", "p")).select("doc_id", "para_idx", "p.original", "p.output")


def change_rows(rewritten: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, para_idx, change_seq, category, before, after, context."""
    rows = rewritten.select("doc_id", *keep, F.posexplode("paragraphs").alias("para_idx", "p"))
    return rows.select("doc_id", *keep, "para_idx", F.posexplode("p.changes").alias("change_seq", "c")).select("doc_id", *keep, "para_idx", "change_seq", "c.*")


def join_paragraphs(paragraphs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """Rows of paragraphs back to doc_id, output; in order of para_idx."""
    own = F.array_sort(F.collect_list(F.struct("para_idx", "output")))
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["output"]), sep).alias("output"))


def change_count() -> Column:
    return F.aggregate("paragraphs", F.lit(0), lambda n, p: n + F.size(p["changes"]))


def document_stats(rewritten: DataFrame, *, sep: str = "\n\n") -> DataFrame:
    """doc_id, before and after (readability), change_count, words_saved."""
    both = rewritten.select("doc_id", X.flesch(output_text(sep, "original")).alias("before"), X.flesch(output_text(sep)).alias("after"), change_count().alias("change_count"))
    return both.withColumn("words_saved", F.col("before.words") - F.col("after.words"))


def changes_by_category(rewritten: DataFrame, by: str) -> DataFrame:
    """Changes of each category per value of ``by``, and in all (null); ``docs`` are distinct documents in both. Changes
    are counted per document before they are summed up."""
    own = change_rows(rewritten, by).groupBy(by, "category", "doc_id").agg(F.count("*").alias("n"))
    return own.groupingSets([[by, "category"], ["category"]], by, "category").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"))


def rule_usage(rewritten: DataFrame, rules_table: DataFrame) -> DataFrame:
    """Of every swap and deletion: list, find, hits, docs; 0 where it never fired."""
    category = F.create_map(*[F.lit(x) for k, v in CATEGORIES.items() for x in (v, k)], F.lit(OPENER), F.lit("sentenceStartDeletes"), F.lit(FILLER), F.lit("midSentenceDeletes"))
    found = F.lower(F.translate("before", "’", "'"))
    opener = F.regexp_replace(found, " …$", "")
    inner = F.regexp_replace(found, r"^,\s*|\s*,$", "")
    fired = change_rows(rewritten).select("doc_id", F.try_element_at(category, F.col("category")).alias("list"), F.when(F.col("category") == OPENER, opener).when(F.col("category") == FILLER, inner).otherwise(found).alias("key"))
    hits = fired.filter("list is not null").groupBy("list", "key").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))
    rules = rules_table.filter(~F.col("list").isin("flagWords", "protectedTerms")).select("list", "find", F.lower("find").alias("key"))
    return rules.join(hits, ["list", "key"], "left").select("list", "find", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("docs", F.lit(0)).alias("docs"))
