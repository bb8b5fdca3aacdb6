"""Text functions as Column expressions: words, sentences, syllables, readability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ABBREVIATIONS, AFTER_WORD, BEFORE_WORD, BLANKS, EMOJI, GUARD, HEADING, SPACES, WORD, WS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def strip(text: Column) -> Column:
    """White space of the rules' dialect off both ends."""
    return F.btrim(text, F.lit(BLANKS))


def round1(x: Column) -> Column:
    """One decimal; halves go up, also below zero."""
    return F.floor(x * 10 + 0.5) / 10


def words(text: Column) -> Column:
    """array<string> of words."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def guarded(text: Column) -> Column:
    """Full stops of abbreviations and decimals replaced by a character of the same length."""
    return replace(replace(text, rf"{BEFORE_WORD}({ABBREVIATIONS})\.", f"$1{GUARD}"), r"([0-9])\.([0-9])", f"$1{GUARD}$2")


def sentences(text: Column) -> Column:
    """array<string> of trimmed sentences. Headings have no full stop, so they run on into the next one."""
    parts = F.split(guarded(text), rf"(?<=[.!?]){WS}+")
    return F.filter(F.transform(parts, lambda s: strip(F.translate(s, GUARD, "."))), lambda s: s != "")


def is_heading(sentence: Column) -> Column:
    return sentence.rlike(HEADING)


def syllable_count(text: Column) -> Column:
    """Syllables of all words of a text, estimated: words of up to three letters have one, silent endings
    and a leading y don't count, then pairs of vowels do. One pass a rule over the words as one string."""
    letters = replace(F.lower(F.array_join(words(text), " ")), "[^a-z ]", "")
    short = r"(?<![a-z])[a-z]{1,3}(?![a-z])"
    longer = replace(letters, short, "")
    stems = replace(longer, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?![a-z])", "")
    only_y = F.regexp_count(stems, F.lit("(?<![a-z])y(?![a-z])"))
    bare = replace(stems, "(?<![a-z])y", "")
    none = F.regexp_count(bare, F.lit("(?<![a-z])[^aeiouy ]+(?![a-z])"))
    return F.regexp_count(letters, F.lit(short)) + only_y + F.regexp_count(bare, F.lit("[aeiouy]{1,2}")) + none


def syllables(word: Column) -> Column:
    """Syllables of one word."""
    return syllable_count(word)


def flesch(text: Column) -> Column:
    """struct<score, grade, words, sentences, avg_sentence>; zeros for a text without words or sentences.
    Heading lines count as words, not as sentences."""
    return flesch_of(word_count(text), F.size(sentences(replace(text, rf"(?md)^#+{WS}.*$", ""))), syllable_count(text))


def flesch_of(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    def scored(n: Column) -> Column:
        w, s, y = n["w"], n["s"], n["y"]
        per_sentence, per_word = w / s, y / w
        some = (w > 0) & (s > 0)

        def value(x: Column) -> Column:
            return F.when(some, round1(x)).otherwise(F.lit(0.0))

        return F.struct(
            value(206.835 - 1.015 * per_sentence - 84.6 * per_word).alias("score"),
            value(0.39 * per_sentence + 11.8 * per_word - 15.59).alias("grade"),
            F.when(some, w).otherwise(0).cast("int").alias("words"),
            F.when(some, s).otherwise(0).cast("int").alias("sentences"),
            value(per_sentence).alias("avg_sentence"),
        )

    return let(F.struct(n_words.alias("w"), n_sentences.alias("s"), n_syllables.alias("y")), scored)


def snippet(text: Column, start: Column, length: Column, around: int = 32) -> Column:
    """What stands around a span, white space collapsed, with ellipses where it is cut. ``start`` from 0."""
    begin = F.greatest(F.lit(0), start - around)
    end = F.least(F.length(text), start + length + around)
    inner = replace(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")), f"{WS}+", " ")
    return F.concat(F.when(begin > 0, "…").otherwise(""), inner, F.when(end < F.length(text), "…").otherwise(""))


def match_case(source: Column, replacement: Column) -> Column:
    """The replacement in the casing of what it replaces."""
    first = F.substring(source, 1, 1)
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when((F.upper(source) == source) & (F.length(source) > 2), F.upper(replacement)).when(first == F.upper(first), capital).otherwise(replacement)


def cut(text: Column, length: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def remove_emojis(text: Column) -> Column:
    """Emoji off, and the spaces that they leave."""
    return replace(replace(replace(text, EMOJI, ""), " {2,}", " "), " +([.,;:!?])", "$1")


def fix_dashes(text: Column) -> Column:
    """Ranges to "a to b", dashes between words to commas, no comma before other punctuation."""
    out = replace(text, rf"([0-9]){WS}*[–—]{WS}*([0-9])", "$1 to $2")
    out = replace(out, rf"{WS}*[—–]{WS}*", ", ")
    out = replace(out, rf"([^{SPACES}]){WS}*--{WS}*([^{SPACES}])", "$1, $2")
    return replace(out, rf",{WS}*([.,;:!?])", "$1")


def tidy(text: Column) -> Column:
    """Runs of spaces to one, none at the end of a line."""
    return replace(replace(text, " {2,}", " "), " +\n", "\n")


def normalized(text: Column) -> Column:
    """Line ends to newlines, at most one empty line, trimmed: what paragraphs are split from."""
    return strip(replace(replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n{3,}", "\n\n"))


def paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """array<string> of paragraphs; a text of white space has none."""
    return let(normalized(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, F.lit(sep.replace("\n", r"\n")))))
