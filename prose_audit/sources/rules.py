"""Style rules as tables: defaults, JSON and line formats, comparison of two sets.

A rule table is a DataFrame of rows (list, pos, find, replace, verb_only, reason, suggestion, dim,
alternatives); what a list has no use for is null. ``Rules`` is the same on the driver, for helpers that
need compiled patterns; rule sets are a few hundred rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import default_rules as D

SWAP_LISTS = ("fillerPhrases", "hypeSwaps", "simpleSwaps", "contractions")
DELETE_LISTS = ("sentenceStartDeletes", "midSentenceDeletes")
SCHEMA = (
    "list string, pos int, find string, replace string, verb_only boolean, reason string, suggestion string, dim string, alternatives array<string>"
)


@dataclass
class Rules:
    """A rule set. Swaps and flags are (find, replace, verb_only) and (find, reason, suggestion, dim, alternatives)."""

    swaps: dict[str, list[tuple[str, str, bool]]] = field(default_factory=dict)
    deletes: dict[str, list[str]] = field(default_factory=dict)
    flags: list[tuple[str, str, str, str | None, list[str] | None]] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    settings: dict = field(default_factory=dict)


def swap_line(line: str) -> tuple[str, str, bool] | None:
    """``find => replace [| verbOnly]``; None unless there is one arrow and something to find."""
    parts = line.split("=>")
    if len(parts) != 2 or not parts[0].strip():
        return None
    replace, bar, flag = parts[1].partition("|")
    return parts[0].strip(), replace.strip(), bool(bar) and flag.strip() == "verbOnly"


def flag_line(line: str) -> tuple[str, str, str, str | None, list[str] | None] | None:
    """``word | reason | suggestion [| dim [| a; b]]``; an empty alternative at the end means deletion."""
    parts = [p.strip() for p in line.split("|")]
    if not parts[0]:
        return None
    parts += [""] * (3 - len(parts))
    alternatives = [a.strip() for a in parts[4].split(";")] if len(parts) > 4 else None
    return parts[0], parts[1] or "Blocked word", parts[2] or "Rewrite this", (parts[3] or None) if len(parts) > 3 else None, alternatives


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def default_rules(protected: list[str] | None = None) -> Rules:
    """The default rule set. Protected terms are the caller's: brand and product names."""
    swaps = {"fillerPhrases": D.FILLER_PHRASES, "hypeSwaps": D.HYPE_SWAPS, "simpleSwaps": D.SIMPLE_SWAPS, "contractions": D.CONTRACTIONS}
    return Rules(
        {k: [swap_line(x) for x in _lines(v)] for k, v in swaps.items()},
        {"sentenceStartDeletes": _lines(D.SENTENCE_START_DELETES), "midSentenceDeletes": _lines(D.MID_SENTENCE_DELETES)},
        [flag_line(x) for x in _lines(D.FLAG_WORDS)],
        list(protected or []),
        dict(D.SETTINGS),
    )


def load_style_config(text: str) -> Rules:
    """Rules of a JSON config; it must have ``settings`` and ``simpleSwaps``. Lists that are missing are
    empty; so are numbers their defaults, but switches that are missing are off."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or "settings" not in raw or "simpleSwaps" not in raw:
        raise ValueError("a style config has settings and simpleSwaps")
    settings = {"maxSentenceWords": 28, "maxParagraphSentences": 6, "splitMaxTier": 2, "minClauseWords": 4}
    settings |= {k: v for k, v in raw["settings"].items() if v or k not in settings}
    return Rules(
        {k: [(r["find"], r.get("replace", ""), bool(r.get("verbOnly"))) for r in raw.get(k, [])] for k in SWAP_LISTS},
        {k: list(raw.get(k, [])) for k in DELETE_LISTS},
        [(r["find"], r.get("reason", "Blocked word"), r.get("suggestion", "Rewrite this"), r.get("dim"), r.get("alternatives")) for r in raw.get("flagWords", [])],
        list(raw.get("protectedTerms", [])),
        settings,
    )


def export_config(rules: Rules) -> str:
    """JSON that ``load_style_config`` reads back to the same rules."""
    out: dict = {"protectedTerms": rules.protected}
    for k in SWAP_LISTS:
        out[k] = [{"find": f, "replace": r} | ({"verbOnly": True} if v else {}) for f, r, v in rules.swaps.get(k, [])]
    for k in DELETE_LISTS:
        out[k] = rules.deletes.get(k, [])
    out["flagWords"] = [
        {"find": f, "reason": r, "suggestion": s} | ({"dim": d} if d else {}) | ({"alternatives": a} if a is not None else {}) for f, r, s, d, a in rules.flags
    ]
    return json.dumps(out | {"settings": rules.settings}, ensure_ascii=False, indent=1)


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """All rules as rows, ``pos`` counting from 0 in each list."""
    rows: list[tuple] = []
    for name, swaps in rules.swaps.items():
        rows += [(name, i, f, r, v, None, None, None, None) for i, (f, r, v) in enumerate(swaps)]
    for name, phrases in rules.deletes.items():
        rows += [(name, i, p, None, None, None, None, None, None) for i, p in enumerate(phrases)]
    rows += [("flagWords", i, f, None, None, r, s, d, a) for i, (f, r, s, d, a) in enumerate(rules.flags)]
    rows += [("protectedTerms", i, t, None, None, None, None, None, None) for i, t in enumerate(rules.protected)]
    return spark.createDataFrame(rows, SCHEMA)


def parse_swap_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a line table that are swap rules: find, replace, verb_only."""
    parts = F.split(line, "=>")
    right = F.split(F.element_at(parts, 2), r"\|", 2)
    return lines.filter((F.size(parts) == 2) & (F.trim(F.element_at(parts, 1)) != "")).select(
        F.trim(F.element_at(parts, 1)).alias("find"),
        F.trim(F.element_at(right, 1)).alias("replace"),
        F.coalesce(F.trim(F.get(right, F.lit(1))) == "verbOnly", F.lit(False)).alias("verb_only"),
    )


def parse_flag_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a line table that are flag rules: find, reason, suggestion, dim, alternatives."""
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))

    def part(i: int, default: str | None) -> F.Column:
        return F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit(default).cast("string"))

    return lines.filter(F.get(parts, F.lit(0)) != "").select(
        F.get(parts, F.lit(0)).alias("find"),
        part(1, "Blocked word").alias("reason"),
        part(2, "Rewrite this").alias("suggestion"),
        part(3, None).alias("dim"),
        F.transform(F.split(F.get(parts, F.lit(4)), ";"), lambda a: F.trim(a)).alias("alternatives"),
    )


def swap_lines(table: DataFrame) -> DataFrame:
    """One text per swap list, in the line format and in order."""
    line = F.concat("find", F.lit(" => "), "replace", F.when(F.col("verb_only"), " | verbOnly").otherwise(""))
    swaps = table.filter(F.col("list").isin(*SWAP_LISTS)).groupBy("list")
    return swaps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def compare_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """list, find, status (added, removed, changed) of two rule tables; order within a list doesn't count."""
    body = F.struct("replace", "verb_only", "reason", "suggestion", "dim", "alternatives")
    a, b = (t.select("list", "find", body.alias(n)) for t, n in ((old, "a"), (new, "b")))
    both = a.join(b, ["list", "find"], "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("list", "find", status.alias("status")).filter("status is not null")


def stale_lexicons(packs: DataFrame, months: int = 12) -> DataFrame:
    """Lexicon packs older than ``months``: pack, version, pack_date, months_old."""
    age = F.months_between(F.current_date(), F.max("pack_date"))
    return packs.groupBy("pack", "version").agg(F.max("pack_date").alias("pack_date"), age.alias("months_old")).filter(F.col("months_old") > months)
