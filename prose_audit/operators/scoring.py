"""Scores: how formulaic a document reads, from 0 to 20. Never a claim about who wrote it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import java
from ..functions.phrases import DisjointSpans
from ..sources.rules import Rules
from .flags import WORD_CHOICE, dimension_counts, dimension_counts_of_both, document_flags
from .rewrite import output_text

# Keys, names and default weights of the dimensions; bands of both models.
DIMENSIONS = [("d1", "Stock wording", 1.0), ("d2", "Sentence rhythm", 1.0), ("d3", "Fence-sitting", 1.0), ("d4", "Missing specifics", 1.0), ("d5", "No personal voice", 1.0)]
WEIGHTED = {"d1": 0.75, "d2": 1.25, "d3": 1.0, "d4": 1.25, "d5": 0.75}
VERDICTS = [(15.0, "heavy"), (10.0, "moderate"), (6.0, "light")]
BANDS = [(4.0, "human-written"), (8.5, "mild"), (13.5, "substantial"), (20.0, "heavy")]

#: Signs of an author: the first person, a date, an exact figure, an opinion or a named person. Ours to choose.
PRESENCE = {
    "first_person": r"\b(?:[Ii]|[Mm]y|[Mm]e|[Mm]ine|[Ww]e|[Oo]ur|[Uu]s)\b",
    "date": r"\b(?:(?:19|20)\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b",
    "figure": r"(?<![\w.])\d+(?:[.,]\d+)+\b|(?<![\w.])\d*[1-46-9]\b|[$€£]\d",
    "opinion": r"\b(?:I|we) (?:think|believe|prefer|doubt|hope|like|hate|love|regret|disagree)\b|\b(?:Mr|Mrs|Ms|Dr)\. [A-Z]|(?<=[a-z,] )[A-Z][a-z]+ [A-Z][a-z]+",
}


#: What a match of the sign begins with, as the inside of a character class: elsewhere Spark needn't try the pattern.
PRESENCE_FIRST = {"first_person": "IiMmWwOoUu", "date": "12JFMASONDTW", "figure": "0-9$€£", "opinion": "A-Zw"}


def presence_pattern(sign: str) -> str:
    return f"(?=[{PRESENCE_FIRST[sign]}])(?:{java(PRESENCE[sign])})"


def dimension_table(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """key, name, weight; five rows."""
    return spark.createDataFrame([(k, n, float((weights or {}).get(k, w))) for k, n, w in DIMENSIONS], "key string, name string, weight double")


def density_score(n_flags: Column, n_words: Column) -> Column:
    """0 to 4 in halves: flags per 1,000 words, nine or more being 4."""
    per = F.when(n_words > 0, n_flags * 1000.0 / n_words).otherwise(0.0)
    return F.least(F.lit(4.0), F.floor(per / 9 * 4 * 2 + 0.5) / 2)


def authorial_presence(text: Column) -> Column:
    """struct<score, signals, missing>: 4 less the number of signs found."""
    hits = X.let(text, lambda t: F.array(*[F.when(t.rlike(presence_pattern(k)), F.lit(k)) for k in PRESENCE]))
    signals = F.filter(hits, lambda x: x.isNotNull())
    return X.let(signals, lambda s: F.struct((4.0 - F.size(s)).alias("score"), s.alias("signals"), F.array_except(F.array(*map(F.lit, PRESENCE)), s).alias("missing")))


def total(scores: list[Column], weights: list[float]) -> Column:
    """20 times the weighted mean of scores of up to 4, to one decimal."""
    top = sum((s * w for s, w in zip(scores, weights)), F.lit(0.0))
    return X.round1(20 * top / (4 * sum(weights)))


def verdict(score: Column) -> Column:
    out = F.when(score > 0, "low").otherwise("none")
    for least, name in reversed(VERDICTS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def band(score: Column, n_words: Column | None = None) -> Column:
    """The band of the weighted model; none for a text under 150 words."""
    out = F.lit(None).cast("string")
    for most, name in reversed(BANDS):
        out = F.when(score <= most, name).otherwise(out)
    return F.when(n_words < 150, "insufficient_text").otherwise(out) if n_words is not None else out


def score_documents(docs: DataFrame, flags: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` and ``flags(doc_id, dim)`` → doc_id, n_words, d1 to d5, total, verdict, signals,
    missing. Flags are summed per document before the join; a document without flags scores 0 in d1 to d4."""
    counts = flags.groupBy("doc_id").agg(*[F.count_if(F.col("dim") == k).alias(f"n_{k}") for k in ("d1", "d2", "d3", "d4")])
    own = docs.select("doc_id", X.word_count(F.coalesce("text", F.lit(""))).alias("n_words"), authorial_presence(F.coalesce("text", F.lit(""))).alias("p"))
    rows = own.join(counts, "doc_id", "left").fillna(0, [f"n_{k}" for k in ("d1", "d2", "d3", "d4")])
    dims = {k: density_score(F.col(f"n_{k}"), F.col("n_words")) for k in ("d1", "d2", "d3", "d4")} | {"d5": F.col("p.score")}
    w = [float((weights or {}).get(k, d)) for k, _, d in DIMENSIONS]
    scored = rows.select("doc_id", "n_words", *[v.alias(k) for k, v in dims.items()], F.col("p.signals").alias("signals"), F.col("p.missing").alias("missing"))
    out = scored.withColumn("total", total([F.col(k) for k, _, _ in DIMENSIONS], w))
    return out.withColumn("verdict", verdict(F.col("total")))


def score_in_row(text: Column, paragraphs: Column, rules: Rules, weights: dict[str, float] | None = None) -> Column:
    """struct<n_words, d1 to d5, total, verdict> of a text and its paragraphs (array<string>): what score_documents
    gives, with no table of flags, join or shuffle."""
    return score_of_counts(text, dimension_counts(paragraphs, rules), weights)


def score_of_counts(text: Column, counts: Column, weights: dict[str, float] | None = None) -> Column:
    """The same, from the flags of the text's paragraphs by dimension."""
    both = F.struct(text.alias("t"), counts.alias("c"))
    own = X.let(both, lambda b: F.struct(X.word_count(b["t"]).alias("n"), b["c"].alias("c"), F.size(document_flags(b["t"])).alias("whole"), authorial_presence(b["t"])["score"].alias("d5")))
    w = [float((weights or {}).get(k, d)) for k, _, d in DIMENSIONS]

    def scored(x: Column) -> Column:
        flags = {k: x["c"][k] + x["whole"] if k == "d2" else x["c"][k] for k in ("d1", "d2", "d3", "d4")}
        dims = {k: density_score(n, x["n"]) for k, n in flags.items()} | {"d5": x["d5"]}
        return F.struct(x["n"].alias("n_words"), *[v.alias(k) for k, v in dims.items()], total(list(dims.values()), w).alias("total"))

    return X.let(X.let(own, scored), lambda s: F.struct(*[s[k].alias(k) for k in ("n_words", "d1", "d2", "d3", "d4", "d5", "total")], verdict(s["total"]).alias("verdict")))


def score_before_after(rewritten: DataFrame, rules: Rules, *, sep: str = "\n\n", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, before and after: scores of the originals and of what the rewrite made of them."""

    counted = rewritten.withColumn("__c", dimension_counts_of_both(F.col("paragraphs.original"), F.col("paragraphs.output"), rules))

    def side(name: str, which: str) -> Column:
        return score_of_counts(output_text(sep, name), F.col("__c")[which], weights)

    return counted.select("doc_id", side("original", "before").alias("before"), side("output", "after").alias("after"))


def marketing_share(flags: Column) -> Column:
    """Of a document's flags for stock wording the share whose reason is marketing; 0 if there are none."""
    stock = F.filter(flags, lambda f: (f["type"] == WORD_CHOICE) & ~F.lower(f["reason"]).rlike("connective|legalese|abstract|complex construction|vague"))
    return X.let(stock, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda f: F.contains(F.lower(f["reason"]), F.lit("marketing")))) / F.size(x)).otherwise(0.0))


def weighted_band(scores: DataFrame) -> DataFrame:
    """``scores`` with the weighted model's total and band."""
    value = total([F.col(k) for k, _, _ in DIMENSIONS], [WEIGHTED[k] for k, _, _ in DIMENSIONS])
    return scores.withColumn("weighted_total", value).withColumn("band", band(F.col("weighted_total"), F.col("n_words")))


def projected_score(flags: DataFrame, handled: DataFrame) -> DataFrame:
    """Score from the share of flags that are still open: doc_id, d1 to d4 (in halves), total.

    ``handled(doc_id, para_idx, type, found, start)`` are flags that a person has dealt with.
    """
    key = ["doc_id", "para_idx", "type", "found", "start"]
    marked = flags.join(handled.select(*key, F.lit(True).alias("done")).distinct(), key, "left")
    counts = [F.count_if(F.col("dim") == k).alias(f"all_{k}") for k in ("d1", "d2", "d3", "d4")] + [F.count_if((F.col("dim") == k) & F.col("done").isNull()).alias(f"open_{k}") for k in ("d1", "d2", "d3", "d4")]
    rows = marked.groupBy("doc_id").agg(*counts)
    for k in ("d1", "d2", "d3", "d4"):
        rows = rows.withColumn(k, F.when(F.col(f"all_{k}") > 0, F.floor(F.col(f"open_{k}") / F.col(f"all_{k}") * 8 + 0.5) / 2).otherwise(0.0))
    out = rows.withColumn("total", F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4") + 4.0)
    return out.select("doc_id", "d1", "d2", "d3", "d4", "total", verdict(F.col("total")).alias("verdict"))


def open_flags(flags: DataFrame, handled: DataFrame) -> DataFrame:
    """Flags that nobody has reviewed or dismissed."""
    key = ["doc_id", "para_idx", "type", "found", "start"]
    return flags.join(handled.select(key), [flags[k].eqNullSafe(handled[k]) for k in key], "left_anti")


def rhythm_rules(metrics: DataFrame) -> DataFrame:
    """``metrics`` with d2_rules (those that fired, in order) and d2 (their number, 4 at most)."""
    # fixed values: names and thresholds of the rules
    rules = [
        ("low variation", F.col("sent_len_cv") < 0.45), ("low oscillation", F.col("burstiness") < 0.35), ("transitions", F.col("transition_open_rate") > 0.35),
        ("tricolons", F.col("tricolon_density") > 4.0), ("closing restatement", F.col("closing_restatement")), ("equal sections", (F.col("section_len_cv") < 0.25) & (F.col("sections") >= 3)),
    ]
    fired = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return metrics.withColumn("d2_rules", fired).withColumn("d2", F.least(F.size("d2_rules"), F.lit(4)))


def section_scores(sections: DataFrame, most: float = 4.0) -> DataFrame:
    """``sections(doc_id, section, score)`` with the document's mean and whether a section is far off it."""
    mean = F.avg("score").over(Window.partitionBy("doc_id"))
    return sections.withColumn("doc_mean", mean).withColumn("deviates", F.abs(F.col("score") - F.col("doc_mean")) > most)


def guards(rows: DataFrame) -> DataFrame:
    """``rows(n_words, section_len_cv, sections, marketing_share)`` with ``guards``: array<struct<id, reason>>.

    G-1 (second-language English) can't be run here; every report says so.
    """
    found = F.array(
        F.when(F.col("n_words") < 400, F.struct(F.lit("G-5").alias("id"), F.lit("Under 400 words").alias("reason"))),
        F.when((F.col("section_len_cv") < 0.15) & (F.col("sections") >= 3), F.struct(F.lit("G-3").alias("id"), F.lit("Sections of equal length").alias("reason"))),
        F.when(F.col("marketing_share") > 0.5, F.struct(F.lit("G-6").alias("id"), F.lit("Marketing wording for the most part").alias("reason"))),
    )
    return rows.withColumn("guards", F.filter(found, lambda g: g.isNotNull()))


def genre_guard(rows: DataFrame, genres: DataFrame, formal: tuple[str, ...] = ("legal", "academic", "medical", "regulatory", "compliance")) -> DataFrame:
    """``rows`` with guards, plus G-2 for documents of a genre with conventions of its own."""
    fired = F.when(F.col("genre").isin(*formal), F.array(F.struct(F.lit("G-2").alias("id"), F.concat(F.lit("Conventions of the genre: "), "genre").alias("reason"))))
    empty = F.array().cast("array<struct<id:string,reason:string>>")
    return rows.join(genres, "doc_id", "left").withColumn("guards", F.concat("guards", F.coalesce(fired, empty))).drop("genre")


def baseline_guard(rows: DataFrame, deltas: DataFrame, normal: float = 1.0) -> DataFrame:
    """``rows`` with guards, plus G-7 for documents within ``normal`` of the nearest author's own style."""
    nearest = deltas.groupBy("doc_id").agg(F.min_by("author_id", F.struct("delta", "author_id")).alias("author"), F.min("delta").alias("nearest"))
    fired = F.when(F.col("nearest") <= normal, F.array(F.struct(F.lit("G-7").alias("id"), F.concat(F.lit("Reads like earlier texts of "), "author").alias("reason"))))
    empty = F.array().cast("array<struct<id:string,reason:string>>")
    return rows.join(nearest, "doc_id", "left").withColumn("guards", F.concat("guards", F.coalesce(fired, empty))).drop("author", "nearest")


def confidence(n_words: Column, n_guards: Column, strong_dimensions: Column, single: Column) -> Column:
    """low, moderate or high: moderate, less for short texts, guards and evidence of one kind, more for long
    texts and many kinds."""
    level = 1 - (n_words < 400).cast("int") - (n_guards > 0).cast("int") - single.cast("int") + (n_words > 1500).cast("int") + (strong_dimensions >= 4).cast("int")
    level = F.when(n_words < 150, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), level)))
    return F.element_at(F.array(F.lit("low"), F.lit("moderate"), F.lit("high")), (level + 1).cast("int"))


def validate_scores(scores: DataFrame) -> DataFrame:
    """Rows that break the rules: a total outside 0 to 20, or a verdict that isn't one."""
    names = ["none", "low", *[n for _, n in VERDICTS]]
    wrong = F.when(~F.col("total").between(0, 20) | F.col("total").isNull(), "total out of range").when(~F.col("verdict").isin(names) | F.col("verdict").isNull(), "unknown verdict")
    return scores.withColumn("failure", wrong).filter("failure is not null")


def resolve_findings(findings: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``findings(*by, id, start, end, severity)`` without overlaps: the more severe stays, then the longer, then the
    first (by start, end, id). A null severity is 0.

    Findings are sorted by place once; a running maximum of their ends cuts them into islands that touch no other, so
    only what overlaps is gathered. In an island the findings, most severe first, go into a sorted set of disjoint
    spans, each by one binary search.
    """
    order = Window.partitionBy(*by).orderBy("start", "end", "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = findings.select(*by, "id", "start", "end", F.coalesce("severity", F.lit(0)).alias("severity"))
    cut = own.withColumn("opens", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    islands = cut.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rank = F.struct((-F.col("severity")).alias("s"), (F.col("start") - F.col("end")).alias("l"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("id").alias("id"), F.col("severity").alias("severity"))
    grouped = islands.groupBy(*by, "island").agg(F.array_sort(F.collect_list(rank)).alias("f"))

    @F.pandas_udf("array<int>")
    def kept(starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(starts, ends):
            spans = DisjointSpans()
            out.append([i for i, (x, y) in enumerate(zip(a, b)) if spans.add(int(x), int(y))])
        return pd.Series(out)

    places = kept(F.transform("f", lambda x: x["a"].cast("long")), F.transform("f", lambda x: x["b"].cast("long")))
    rows = grouped.select(*by, "f", F.explode(places).alias("i")).select(*by, F.get("f", F.col("i")).alias("x"))
    return rows.select(*by, F.col("x.id").alias("id"), F.col("x.a").alias("start"), F.col("x.b").alias("end"), F.col("x.severity").alias("severity"))


def cap_highlights(findings: DataFrame, docs: DataFrame, share: float = 0.2) -> DataFrame:
    """``findings`` with ``shown``: whether the highlighted characters up to here, most severe first, are at
    most this share of the text (``docs(doc_id, n_chars)``)."""
    window = Window.partitionBy("doc_id").orderBy(F.desc("severity"), "start", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = findings.withColumn("used", F.sum(F.col("end") - F.col("start")).over(window))
    return used.join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("shown", F.col("used") <= share * F.col("n_chars")).drop("used", "n_chars")


def report_json(scores: DataFrame, versions: dict[str, str]) -> DataFrame:
    """doc_id, report: a JSON report of each row, with versions, guards that weren't run and the limits of it."""
    head = F.struct(*[F.lit(v).alias(k) for k, v in sorted(versions.items())])
    body = F.struct(
        head.alias("version"), F.struct("*").alias("result"), F.array(F.lit("G-1")).alias("guards_not_run"),
        F.lit("The score says how formulaic the text reads. It is no statement about who wrote it.").alias("limitation"),
    )
    return scores.select("doc_id", F.to_json(body).alias("report"))
