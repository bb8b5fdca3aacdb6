"""Sentence splits: where a compound sentence can become two, or why not.

Candidates are offered, never applied by the rewrite. In doubt there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.patterns import WORD, WS
from ..sources.rules import Rules
from .spans import find_sentences, find_unsplittable, overlaps

CANDIDATE = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("capitalize_at", T.IntegerType()), T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("preview", T.StringType()),
    ]
)

# The closed word lists of the clause test.
PRONOUNS = set("i we you he she it they this that these those there who one someone everyone nobody nothing".split())
DETERMINERS = set("the a an its our their his her my your this that these those each every both all most some any no another either neither".split())
AUXILIARIES = set("is are was were be been being am has have had do does did can could will would shall should may might must".split())
NO_VERBS = set("this business process analysis address needs means series species news thanks".split())
SUBORDINATORS = set("because since although though while whereas unless until after before if when whenever wherever as whether".split())
RELATIVES = set("which whom whose".split())
PREPOSITIONS = set("in on at by for with from of to about into over under between through during without within against among".split())
#: Coordinators, and whether they stay when the sentence is split.
KEEPS = {"but": True, "so": True, "yet": True, "and": False, "or": False, "nor": False}

_WORD = re.compile(WORD)
_JOINT = re.compile(rf",{WS}+({'|'.join(KEEPS)}){WS}+", re.I)
_SEMICOLON = re.compile(rf"{WS}*;{WS}*")
_SKIP = re.compile(rf"\A{WS}*(?:#{{1,6}}{WS}|>|[-*+]{WS}|[0-9]+[.)]{WS})")
_CONTRACTED = re.compile(r"(?:['’](?:s|re|ve|ll|d)|n['’]t)$")


def is_finite(word: str) -> bool:
    low = word.lower()
    return low in AUXILIARIES or bool(_CONTRACTED.search(low)) or low.endswith(("s", "ed", "ing")) and low not in NO_VERBS and len(low) > 3


def is_independent(clause: str, *, opens: bool = False) -> bool:
    """Whether a clause has a subject of its own and a finite verb after it. ``opens``: it begins the sentence,
    so a capital says nothing."""
    words = _WORD.findall(clause)
    if len(words) < 2:
        return False
    first = words[0].lower()
    if first in SUBORDINATORS or first in RELATIVES or first in PREPOSITIONS:
        return False
    if first in PRONOUNS or first in DETERMINERS:
        start = 1
    elif first.endswith("ing"):
        return any(w.lower() in AUXILIARIES for w in words[1:4])
    elif first.endswith("ed"):
        return False
    elif words[0][0].isupper() and not opens:
        start = 1
    elif opens and words[0][0].isupper():
        start = 1
    else:
        return False
    for w in words[start : start + 8]:
        if w.lower() in SUBORDINATORS or w.lower() in RELATIVES:
            return False
        if is_finite(w):
            return True
    return False


class Splitter:
    """Candidates of one paragraph."""

    def __init__(self, rules: Rules) -> None:
        self.terms = rules.protected
        self.tier = int(rules.settings.get("splitMaxTier", 2))
        self.least = int(rules.settings.get("minClauseWords", 4))

    def _long_enough(self, *clauses: str) -> bool:
        return all(len(_WORD.findall(c)) >= self.least for c in clauses)

    def find(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        if self.tier <= 0 or not text:
            return out
        kept = None
        for start, end, sentence in find_sentences(text):
            line = text[text.rfind("\n", 0, start) + 1 : end]
            if _SKIP.match(line) or _SKIP.match(sentence) or len(re.findall(r"(?<!\\)\|", sentence)) >= 2 or not self._long_enough(sentence) or len(_WORD.findall(sentence)) < 2 * self.least:
                continue
            if ";" not in sentence and not _JOINT.search(sentence):
                continue
            kept = find_unsplittable(text, self.terms) if kept is None else kept
            found = self._semicolon(text, sentence, start, end, kept) or self._joints(text, sentence, start, end, kept)
            out += found
        return out

    def _candidate(self, text: str, kind: str, tier: int, span: tuple[int, int], start: int, end: int, reason: str) -> tuple:
        """A full stop in the place of ``span``, in the sentence from ``start`` to ``end``."""
        a, b = span
        left, right = text[start:a], text[b:end]
        return kind, tier, a, b, text[a:b], ". ", b, left, right, reason, f"{left}. {right[:1].upper()}{right[1:]}"

    def _semicolon(self, text: str, sentence: str, start: int, end: int, kept: list) -> list[tuple]:
        free = [m for m in _SEMICOLON.finditer(text, start, end) if not overlaps(kept, *m.span())]
        if len(free) != 1 or sentence.count(";") != len(free):
            return []
        a, b = free[0].span()
        left, right = text[start:a], text[b:end]
        if ":" in left or not self._long_enough(left, right) or not right[:1].isalpha() or not is_independent(left, opens=True) or not is_independent(right):
            return []
        return [self._candidate(text, "SPLIT-A", 1, (a, b), start, end, "Compound sentence joined by a semicolon")]

    def _joints(self, text: str, sentence: str, start: int, end: int, kept: list) -> list[tuple]:
        if sentence.count(";") >= 2 and ":" in sentence[: sentence.index(";")]:
            return []
        for m in _JOINT.finditer(text, start, end):
            a, b = m.span()
            word = m[1].lower()
            left, right = text[start:a], text[b:end]
            if overlaps(kept, a, b) or "," in left or not self._long_enough(left, right) or not right[:1].isalpha():
                continue
            stays = KEEPS[word]
            span = (a, m.start(1)) if stays else (a, b)
            if is_independent(left, opens=True) and is_independent(right):
                if self.tier >= 2:
                    return [self._candidate(text, "SPLIT-B", 2, span, start, end, f'Two clauses joined by a comma and "{word}"')]
            elif self.tier >= 3 and not stays and is_imperative(left) and is_imperative(right):
                return [self._candidate(text, "SPLIT-C", 3, span, start, end, "Two instructions; a suggestion of lower confidence")]
        return []


def is_imperative(clause: str) -> bool:
    """Whether a clause opens with the base form of a verb, as far as its shape shows."""
    words = [w.lower() for w in _WORD.findall(clause)]
    if len(words) < 2 or words[0].endswith(("ed", "ing", "ly")) or words[0].endswith("s") and not words[0].endswith("ss"):
        return False
    openers = PRONOUNS | DETERMINERS | AUXILIARIES | SUBORDINATORS | RELATIVES | PREPOSITIONS
    return words[0] not in openers and words[1] in DETERMINERS | PRONOUNS


def split_candidates(text: Column, rules: Rules) -> Column:
    """array<struct> of candidates, in order and without overlaps."""
    names = CANDIDATE.fieldNames()

    @F.pandas_udf(T.ArrayType(CANDIDATE))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Splitter(rules)
        for batch in batches:
            yield pd.Series([[dict(zip(names, c)) for c in own.find(t or "")] for t in batch])

    return run(text)


def independent_clause(clause: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([is_independent(t or "") for t in batch], dtype=bool)

    return run(clause)


def apply_splits(text: Column, candidates: Column) -> Column:
    """The text with all candidates applied, from the last to the first."""

    def one(t: Column, c: Column) -> Column:
        rest = F.substring(t, c["end"] + 1, F.length(t))
        rest = F.when(c["capitalize_at"].isNull(), rest).otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))
        return F.concat(F.substring(t, F.lit(1), c["start"]), c["to"], rest)

    return F.aggregate(F.reverse(F.array_sort(candidates, lambda a, b: a["start"] - b["start"])), text, one)


def suggest_splits(paragraphs: DataFrame, rules: Rules, text: str = "output") -> DataFrame:
    """doc_id, para_idx and the fields of every candidate."""
    return paragraphs.select("doc_id", "para_idx", F.explode(split_candidates(F.col(text), rules)).alias("c")).select("doc_id", "para_idx", "c.*")


def split_report(paragraphs: DataFrame, rules: Rules, text: str = "output") -> DataFrame:
    """Per long sentence: doc_id, para_idx, sent_idx, n_words, tier (null if there is no candidate), reason."""
    rows = paragraphs.select("doc_id", "para_idx", F.posexplode(X.sentences(F.coalesce(text, F.lit("")))).alias("sent_idx", "s"))
    n = X.word_count(F.col("s"))
    long = rows.filter((n > int(rules.settings.get("maxSentenceWords") or 28)) & ~X.is_heading(F.col("s")))
    first = F.get(split_candidates(F.col("s"), rules), F.lit(0))
    why = F.when(~F.col("s").rlike(rf";|,{WS}+(?:{'|'.join(KEEPS)}){WS}"), "no boundary to split at").otherwise("no two independent clauses")
    return long.select("doc_id", "para_idx", "sent_idx", n.alias("n_words"), first.alias("c"), why.alias("why")).select("doc_id", "para_idx", "sent_idx", "n_words", "c.tier", F.coalesce("c.reason", "why").alias("reason"))


def suggest_options(flags: DataFrame, paragraphs: DataFrame, rules: Rules) -> DataFrame:
    """Rewrites on offer for flags(doc_id, para_idx, start, end, type, found): doc_id, para_idx, start, end, label, text, scope.

    Flag words have their alternatives, in the casing of the text (an empty one deletes); semicolons and long
    sentences the split at a joint that is there. Passives and long paragraphs have none.
    """
    words = {r[0].lower(): r[4] for r in rules.flags if r[4]}
    spark = flags.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in words.items()], "key string, alternatives array<string>")
    key = ["doc_id", "para_idx", "start", "end"]
    swaps = flags.filter(F.col("type") == "Word choice").withColumn("key", F.lower(F.translate("found", "’", "'"))).join(F.broadcast(table), "key")
    swaps = swaps.select(*key, "found", F.explode("alternatives").alias("a"))
    by_word = swaps.select(*key, F.when(F.col("a") == "", "delete it").otherwise(F.col("a")).alias("label"), X.match_case(F.col("found"), F.col("a")).alias("text"), F.lit("phrase").alias("scope"))
    joints = suggest_splits(paragraphs, rules).select("doc_id", "para_idx", F.col("start").alias("at"), F.col("end").alias("to_at"), "preview", F.col("reason").alias("label"))
    spans = flags.filter(F.col("type").isin("Semicolon", "Long sentence"))
    by_joint = spans.join(joints, ["doc_id", "para_idx"]).filter((F.col("at") < F.col("end")) & (F.col("start") < F.col("to_at")))
    return by_word.unionByName(by_joint.select(*key, "label", F.col("preview").alias("text"), F.lit("sentence").alias("scope")))
