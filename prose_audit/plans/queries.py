"""Registered queries over the tables, with the SQL that must give the same rows.

The default rules match nothing in the test documents, so queries on rules work on seeded texts: every
document gets a last paragraph from a fixed list, by its doc_id. Paragraphs there end with one newline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.phrases import MOST_PHRASES
from ..functions import sql as sql_functions
from ..operators import corpus, diff, flags, incremental, metrics, nearest, phrase_mining, review, rewrite, scoring, sections, spans, splits
from ..sources import documents as sources
from ..sources import sinks
from ..sources.rules import Rules, default_rules

SEP = "\n"
#: Last paragraphs: text, the rewritten text, and the changes of each category.
SEEDS = [
    ("We utilize tools in order to win.", "We use tools to win.", {"Simpler word": 1, "Filler phrase": 1}),
    ("A seamless plan, needless to say, helps.", "A smooth plan, helps.", {"Hype and AI wording": 1, "Removed filler": 1}),
    ("Basically, they don't leverage it.", "They do not use it.", {"Removed filler opener": 1, "Contraction expanded": 1, "Simpler word": 1}),
    ("Pages 3–5 count — all of them.", "Pages 3 to 5 count, all of them.", {"Dash cleanup": 2}),
    ("Nothing to do here.", "Nothing to do here.", {}),
    ("They cheer 🎉 and will harness the wind, and they should leverage it.", "They cheer and will use the wind, and they should use it.", {"Emoji removal": 1, "Hype and AI wording": 1, "Simpler word": 1}),
    ("Our steady leverage and the small harness stay.", "Our steady leverage and the small harness stay.", {}),
    ("Run `utilize — x` or see https://example.org/utilize and mail a.utilize@example.org today.", "Run `utilize — x` or see https://example.org/utilize and mail a.utilize@example.org today.", {}),
    ("Leverage rose. Leverage the data. Server utilization fell.", "Leverage rose. Use the data. Server use fell.", {"Simpler word": 2}),
    ("WE DON'T UTILIZE IT.", "WE DO NOT USE IT.", {"Contraction expanded": 1, "Simpler word": 1}),
]
#: The rules behind those changes: seed, list, phrase.
SEED_RULES = [
    (0, "simpleSwaps", "utilize"), (0, "fillerPhrases", "in order to"), (1, "hypeSwaps", "seamless"), (1, "midSentenceDeletes", "needless to say"),
    (2, "sentenceStartDeletes", "Basically,"), (2, "contractions", "don't"), (2, "simpleSwaps", "leverage"),
    (5, "hypeSwaps", "harness"), (5, "simpleSwaps", "leverage"), (8, "simpleSwaps", "leverage"), (8, "simpleSwaps", "utilization"), (9, "contractions", "don't"), (9, "simpleSwaps", "utilize"),
]
#: Last paragraphs for the queries on splits: text, and where it is split: kind, tier, end of the first sentence.
SPLIT_SEEDS = [
    ("The engine applies swaps first; the audit runs afterwards.", ("SPLIT-A", 1, 30)),
    ("The score dropped to eleven, but the long sentences were still flagged.", ("SPLIT-B", 2, 27)),
    ("We shipped the module, and the tests passed on the first run.", ("SPLIT-B", 2, 21)),
    ("The corpus is missing, so every threshold stays provisional here.", ("SPLIT-B", 2, 21)),
    ("The engine reads the rules and applies them in order.", None),
    ("Although the tests passed, the release waits.", None),
    ("We ran `a; b` once, which took an hour.", None),
]
#: How severe flags are.
SEVERITIES = {"Missing specifics": 4, "Passive voice": 3, "Long sentence": 3, "Word choice": 2, "Repetitive rhythm": 2, "Semicolon": 1, "Long paragraph": 1}
#: Flag words that do occur in the documents.
OWN_FLAGS = [("of", "Marketing hype", "Cut", None, None), ("is", "Vague connective", "Cut", None, None)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str, texts: list[str] | None = None) -> DataFrame:
    return with_seeds(table(spark, sf_dir, "documents"), texts)


def with_seeds(docs: DataFrame, texts: list[str] | None = None) -> DataFrame:
    """Documents with a last paragraph each."""
    texts = texts or [s for s, _, _ in SEEDS]
    last = F.element_at(F.array(*map(F.lit, texts)), (F.pmod("doc_id", F.lit(len(texts))) + 1).cast("int"))
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(SEP), last))


def readability_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of every document."""
    return corpus.readability(table(spark, sf_dir, "documents")).select("doc_id", "score", "grade", "words", "sentences", "avg_sentence")


def readability_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability by source and language."""
    out = corpus.readability_report(table(spark, sf_dir, "documents"), "source", "lang")
    return out.select("source", "lang", "docs", "words", F.round("avg_score", 4).alias("avg_score"), "min_score", "max_score", F.round("avg_grade", 4).alias("avg_grade"))


def rewrite_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each category by source, and in all."""
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    return rewrite.changes_by_category(done, "source")


def rewrite_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every rewritten document and its number of changes."""
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    return done.select("doc_id", F.md5(rewrite.output_text(SEP).cast("binary")).alias("output_md5"), rewrite.change_count().alias("n_changes"), F.size("paragraphs").alias("n_paragraphs"))


def rewrite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability before and after the rewrite."""
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    return rewrite.document_stats(done, sep=SEP).select("doc_id", F.col("before.score").alias("score_before"), F.col("after.score").alias("score_after"), "change_count", "words_saved")


def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every rule, those that never fired included."""
    from ..sources.rules import rule_table

    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    return rewrite.rule_usage(done, rule_table(spark, default_rules()))


def flag_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each type in every document."""
    rules = default_rules()
    rules.flags = OWN_FLAGS
    out = flags.flag_documents(table(spark, sf_dir, "documents"), rules, para_sep="\n")
    kinds = ["Word choice", "Long sentence", "Passive voice", "Semicolon", "Long paragraph", "Repetitive rhythm"]

    def number(kind: str) -> F.Column:
        return F.size(F.filter("flags", lambda f: f["type"] == kind)).alias(kind.lower().replace(" ", "_"))

    return out.select("doc_id", *map(number, kinds))


def flags_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by type and source, and in all."""
    out = flags.flag_documents(table(spark, sf_dir, "documents"), default_rules(), para_sep="\n")
    return flags.flags_by_type(out, "source")


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules: Rules = default_rules()
    rules.flags = OWN_FLAGS
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    return docs, flags.review_flags(paragraphs, rules, documents=docs)


def density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density scores of stock wording and fence-sitting for flag words of our own."""
    rules = default_rules()
    rules.flags = OWN_FLAGS
    rules.settings |= {"flagPassiveVoice": False}
    out = flags.flag_documents(table(spark, sf_dir, "documents"), rules, para_sep="\n")
    n = X.word_count(F.coalesce("text", F.lit("")))

    def hits(reason: str) -> F.Column:
        return F.size(F.filter("flags", lambda f: f["reason"] == reason))

    return out.select("doc_id", n.alias("n_words"), scoring.density_score(hits("Marketing hype"), n).alias("d1"), scoring.density_score(hits("Vague connective"), n).alias("d3"))


def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions, total, verdict and band of every document."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.explode(X.paragraphs(F.col("text"), SEP)).alias("output"))
    found = flags.review_dimensions(paragraphs, _own_rules(), documents=docs)
    scores = scoring.weighted_band(scoring.score_documents(docs, found))
    return scores.select("doc_id", "n_words", "d1", "d2", "d3", "d4", "d5", "total", "verdict", "weighted_total", "band")


def review_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags with offsets, in reading order."""
    _, found = _review(spark, sf_dir)
    return review.work_list(review.with_nth(found)).select("doc_id", "para_idx", "start", "end", "type", "dim", "found", "kind", "nth", "position", "n")


def flags_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review flags by source and dimension, with totals."""
    docs, found = _review(spark, sf_dir)
    return flags.flags_by_dimension(found, docs, "source")


def flag_rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of flag words of our own, one that never fires included."""
    from ..sources.rules import rule_table

    rules = default_rules()
    rules.flags = [*OWN_FLAGS, ("zzyzx", "Marketing hype", "Cut", None, None)]
    out = flags.flag_documents(table(spark, sf_dir, "documents"), rules, para_sep="\n")
    return flags.flag_rule_usage(out, rule_table(spark, rules))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability before and after the rewrite, changes, and flags that are left."""
    rules = default_rules()
    rules.flags = OWN_FLAGS
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), rules, sep=SEP)
    return flags.document_statistics(done, rules, sep=SEP, para_sep="\n").select("doc_id", F.col("before.grade").alias("grade_before"), F.col("after.grade").alias("grade_after"), "change_count", "flag_count", "words_saved")


def score_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the originals and of the rewritten texts."""
    rules = default_rules()
    rules.flags = [*OWN_FLAGS, ("utilize", "Marketing hype", "Cut", None, None)]
    done = scoring.score_before_after(rewrite.rewrite_documents(seeded(spark, sf_dir), rules, sep=SEP), rules, sep=SEP)
    return done.select("doc_id", *[F.col(f"{side}.{k}").alias(f"{k}_{side}") for side in ("before", "after") for k in ("d1", "d2", "d3", "d4", "d5", "total", "verdict")])


def recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents whose first " of " is edited, after the edit."""
    rules = default_rules()
    rules.flags = OWN_FLAGS
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    first = paragraphs.filter((F.col("para_idx") == 0) & F.contains("output", F.lit(" of ")))
    edits = first.select("doc_id", "para_idx", F.lit(1).alias("seq"), F.lit(" of ").alias("from"), F.lit(" by ").alias("to"), F.lit(0).alias("nth"))
    return review.recompute(paragraphs, edits, rules, sep=SEP)


def replay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit in each first paragraph: the first "the" in capitals."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    edits = docs.select("doc_id", F.lit(0).alias("para_idx"), F.lit(1).alias("seq"), F.lit("the").alias("from"), F.lit("THE").alias("to"), F.lit(0).alias("nth"))
    return review.replay_edits(paragraphs, edits).select("doc_id", "para_idx", F.md5(F.col("output").cast("binary")).alias("output_md5"), "n_edits", F.size("missing").alias("n_missing"))


def sentence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of sentences: mean, spread, extremes, rhythm."""
    out = metrics.document_metrics(table(spark, sf_dir, "documents"), sep=SEP)
    exact = ["words", "sentences", "paragraphs", "sent_len_min", "sent_len_max"]
    return out.select("doc_id", *exact, *[F.round(c, 6).alias(c) for c in ("sent_len_mean", "sent_len_stdev", "sent_len_cv", "short_sent_rate", "burstiness")])


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every document."""
    out = metrics.document_metrics(table(spark, sf_dir, "documents"), sep=SEP)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often frequent words and phrases stand in every document."""
    return metrics.rule_counts(table(spark, sf_dir, "documents"), ["of the", "with", "est", "und", "de la"])


def stock_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First offset and number of a few phrases in every document that has them."""
    found = metrics.stock_hits(F.col("text"), ["of the", "with"])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("h"))
    return rows.select("doc_id", "h.phrase", F.col("h.count").alias("n"), F.get("h.offsets", F.lit(0)).alias("first"))


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards and confidence of every document, authors being the languages of labelled good documents."""
    docs = table(spark, sf_dir, "documents")
    rules = default_rules()
    rules.flags = [("of", "Marketing hype", "Cut", None, None), ("the", "Filler", "Cut", None, None)]
    flagged = flags.flag_words(docs, rules).withColumn("marketing_share", scoring.marketing_share(F.col("flags")))
    own = metrics.document_metrics(flagged, sep=SEP, keep=("marketing_share",)).select("doc_id", F.col("words").alias("n_words"), "section_len_cv", "sections", "marketing_share")
    lexicon = spark.createDataFrame([("academic", "of"), ("legal", "herein")], "genre string, word string")
    out = scoring.genre_guard(scoring.guards(own), metrics.genres(docs, lexicon, 40.0))
    out = scoring.baseline_guard(out, style_distance(spark, sf_dir), 0.8)
    level = scoring.confidence(F.col("n_words"), F.size("guards"), F.lit(0), F.lit(False))
    return out.select("doc_id", F.array_join(F.transform("guards", lambda g: g["id"]), ",").alias("guards"), level.alias("confidence"))


def rhythm_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rhythm rules that fire for every document."""
    out = scoring.rhythm_rules(metrics.document_metrics(table(spark, sf_dir, "documents"), sep=SEP))
    return out.select("doc_id", F.array_join("d2_rules", ", ").alias("d2_rules"), "d2")


def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of about 400 words in long documents."""
    return metrics.sections(table(spark, sf_dir, "documents"))


def class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability scores against quality labels: share over a threshold, mean, deviation."""
    scores = corpus.readability(table(spark, sf_dir, "documents")).select("doc_id", F.col("score").alias("total"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("class"))
    out = corpus.class_rates(scores, labels, 60.0)
    return out.select("class", "docs", F.round("over", 6).alias("over"), F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), "least", "greatest")


def class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the readability score in each class."""
    scores = corpus.readability(table(spark, sf_dir, "documents")).select("doc_id", F.col("score").alias("total"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("class"))
    return corpus.thresholds(scores, labels, [0.05, 0.5, 0.95]).withColumn("threshold", F.round("threshold", 6))


def hardest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of each source with the highest grade."""
    own = corpus.readability(table(spark, sf_dir, "documents")).select("source", "doc_id", "grade")
    return corpus.top_per_group(own, "source", "grade", "doc_id", 5)


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language gate, length gate and cut of every document."""
    docs = table(spark, sf_dir, "documents")
    kept, refused = sources.language_gate(docs)
    both = kept.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)
    cut = sources.truncate_long(sources.short_text_gate(both), 5000)
    return cut.select("doc_id", "reason", "n_words", "length_guard", "truncated", F.length("text").alias("n_kept"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page's source text of conversations, as plain text."""
    turns = table(spark, sf_dir, "conversations")
    blocks = sources.parse_blocks(F.col("text"))
    return turns.select("conv_id", "turn", F.size(blocks).alias("n_blocks"), F.md5(sources.to_plain_text(blocks).cast("binary")).alias("plain_md5"))


def paragraph_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level changes of every paragraph that the rewrite touches."""
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    out = diff.diff_paragraphs(rewrite.paragraph_rows(done))
    return out.select("doc_id", "para_idx", "n_changes", F.size(F.filter("ops", lambda o: o["op"] == "add")).alias("added"), F.size(F.filter("ops", lambda o: o["op"] == "del")).alias("deleted"))


def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits on offer in all documents."""
    docs = seeded(spark, sf_dir, [s for s, _ in SPLIT_SEEDS])
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    return splits.suggest_splits(paragraphs, default_rules()).select("doc_id", "para_idx", "kind", "tier", "start", "end", "left", "right")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long sentence with its split, or why it has none."""
    docs = seeded(spark, sf_dir, [s for s, _ in SPLIT_SEEDS])
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    return splits.split_report(paragraphs, default_rules())


def style_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every document from the style of each language's labelled good documents."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return corpus.style_distance(docs, good.select(F.col("lang").alias("author_id"), "text")).withColumn("delta", F.round("delta", 6))


def letter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by ranked letter sequences, profiles learned from labelled good ones."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return corpus.detect_language(docs, corpus.language_profiles(good))


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentences of every paragraph begin and end."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    rows = paragraphs.select("doc_id", "para_idx", F.explode(spans.sentence_spans(F.col("output"))).alias("s"))
    return rows.select("doc_id", "para_idx", "s.start", "s.end", F.md5(F.col("s.text").cast("binary")).alias("sentence_md5"))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no rule may touch in every seeded document: where, of which kind, and what it is."""
    rows = seeded(spark, sf_dir).select("doc_id", "text", F.explode(spans.protected_ranges(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.start", "r.end", "r.kind", F.substring("text", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("found"))


def match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as words are looked up in it: composed, with plain spaces and quotes."""
    norm = sources.normalize_for_match(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", norm.alias("m"))
    return rows.select("doc_id", F.md5(F.col("m.norm").cast("binary")).alias("norm_md5"), F.size("m.offsets").alias("n_offsets"))


def irregularities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no labelled good document has, and compounds and lists written both ways."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    words = good.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return metrics.irregularities(docs, words)


def visible_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by type that are left when the dimension of rhythm is hidden."""
    _, found = _review(spark, sf_dir)
    return review.visible(found, ["d2"]).groupBy("type", "dim").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in the documents that has three words in a row of an item of the benchmark."""
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.slice(words, i, F.lit(3)))
    plain = F.filter(runs, lambda r: F.forall(r, lambda w: w.rlike(r"\A[A-Za-z]+\z")))
    phrases = F.transform(plain, lambda r: F.lower(F.array_join(r, " ")))
    first = F.split("phrase", " ")
    items = table(spark, sf_dir, "benchmark").filter(F.size(words) > 2).select(F.explode(phrases).alias("phrase")).distinct()
    items = items.filter((F.get(first, F.lit(0)) != F.get(first, F.lit(1))) & (F.get(first, F.lit(0)) != F.get(first, F.lit(2))))
    lexicon = sorted(r.phrase for r in items.limit(MOST_PHRASES + 1).collect())  # more are refused by the index
    return metrics.phrase_hits(table(spark, sf_dir, "documents"), lexicon)


def _own_rules() -> Rules:
    rules = default_rules()
    rules.flags = OWN_FLAGS
    return rules


def flags_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of every review flag."""
    return sections.flags_in_sentences(table(spark, sf_dir, "documents"), _own_rules(), sep=SEP)


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the sections of long documents, and which are far off their document's mean."""
    out = sections.section_scores(table(spark, sf_dir, "documents"), _own_rules(), sep=SEP)
    return out.withColumn("doc_mean", F.round("doc_mean", 6))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review flags that don't overlap, and which of them fit into a fifth of the text."""
    docs, found = _review(spark, sf_dir)
    severity = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in SEVERITIES.items()])
    key = F.concat_ws("|", "para_idx", "type", "found", "start")
    rows = found.filter("start is not null").select("doc_id", "para_idx", key.alias("id"), "start", "end", severity.alias("severity"))
    kept = scoring.resolve_findings(rows, ("doc_id", "para_idx"))
    shown = scoring.cap_highlights(kept, docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars")))
    return shown.select("doc_id", "para_idx", "id", "start", "end", "severity", "shown")


def mined_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of three words in a hundredth of the documents that aren't labelled good, over-used there."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(good, "doc_id", "left")
    out = phrase_mining.mine_phrases(docs, F.col("good"))
    return out.select("phrase", "docs", F.round("rate", 6).alias("rate"), "good_docs", F.round("good_rate", 6).alias("good_rate"))


def sketch_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the readability score by class, from sketches by class and source, and whether their ranks are right."""
    docs = corpus.readability(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("score").alias("total"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("class"))
    scores = sinks.stored(docs.join(labels, "doc_id"), "scores")  # read twice, and filtered by what is costly to tell
    of_class = corpus.merged_sketches(corpus.score_sketches(scores, "class", "source"), "class")
    out = corpus.rank_errors(corpus.sketch_thresholds(of_class, [0.05, 0.5, 0.95]), scores, "class")
    return out.select("class", "docs", "share", (F.col("rank_error") <= corpus.RANK_ERROR).alias("within"))


def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents after an edit in some of them and the dismissal of the semicolons of others: stored sums, patched."""
    rules = _own_rules()
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    folder = sinks.shared_folder(spark, "review")
    incremental.paragraph_state(paragraphs, rules).write.parquet(f"{folder}/state")
    state = spark.read.parquet(f"{folder}/state")
    incremental.document_sums(state).write.parquet(f"{folder}/sums")
    edit = (F.col("para_idx") == 0) & F.contains("output", F.lit(" of ")) & (F.pmod("doc_id", F.lit(4)) == 1)
    edited = paragraphs.withColumn("output", F.when(edit, F.regexp_replace("output", "(?s)\\A(.*?) of ", "$1 by ")).otherwise(F.col("output")))
    marked = edited.filter((F.pmod("doc_id", F.lit(4)) == 2) & F.contains("output", F.lit(";")))
    found = flags.review_flags(marked, rules).filter("type = 'Semicolon'").select(*incremental.FLAG_KEY)
    sums, _ = incremental.patched_sums(spark.read.parquet(f"{folder}/sums"), state, edited, rules, found)
    return incremental.scored(sums)


def rewrite_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite as a stream over the table's folder, begun a second time from its checkpoint: digests and changes."""
    schema = table(spark, sf_dir, "documents").schema
    folder = sinks.shared_folder(spark, "stream")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may be a file or a folder
        done = rewrite.rewrite_documents(with_seeds(stream), default_rules(), sep=SEP)
        out = done.select("doc_id", F.md5(rewrite.output_text(SEP).cast("binary")).alias("output_md5"), rewrite.change_count().alias("n_changes"))
        sinks.stream_to_folder(out, f"{folder}/output", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/output").drop("batch")


def partitioned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability in folders by source; one source written anew with its scores one higher, then read back."""
    scores = corpus.readability(table(spark, sf_dir, "documents").filter("source is not null")).select("doc_id", "source", "score")
    folder = sinks.shared_folder(spark, "results")
    sinks.write_partitioned(scores, folder, ["source"], ["doc_id"])
    first = scores.agg(F.min("source")).first()[0]
    sinks.write_partitioned(scores.filter(F.col("source") == first).withColumn("score", F.col("score") + 1), folder, ["source"], ["doc_id"])
    back = sinks.read_partitioned(spark, folder, scores)
    return back.groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg("score"), 4).alias("avg_score"), F.min("doc_id").alias("first_doc"))


def sql_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and sentences by table functions, in SQL."""
    sql_functions.register(spark, _own_rules())
    docs = table(spark, sf_dir, "documents").select("doc_id", X.paragraphs(F.col("text"), SEP).alias("paragraphs"))
    return spark.sql(
        """SELECT p.doc_id, p.para_idx, f.type, f.dim, count(*) AS n, min(f.start) AS first, max(f.`end`) AS last
        FROM (SELECT doc_id, posexplode(paragraphs) AS (para_idx, paragraph) FROM {docs}) AS p, LATERAL prose_flags(p.paragraph) AS f
        GROUP BY ALL""",
        docs=docs,
    )


def split_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the last, seeded paragraph of every document is split, by the table function."""
    sql_functions.register(spark, default_rules())
    docs = seeded(spark, sf_dir, [s for s, _ in SPLIT_SEEDS]).select("doc_id", F.element_at(X.paragraphs(F.col("text"), SEP), -1).alias("paragraph"))
    return spark.sql("SELECT d.doc_id, s.kind, s.tier, s.start, s.`left`, s.`right` FROM {docs} AS d, LATERAL prose_splits(d.paragraph) AS s", docs=docs)


def nearest_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sources whose labelled good documents every document's style is nearest to."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    out = nearest.nearest_authors(docs, good.select(F.col("source").alias("author_id"), "text"), 3, digits=6)
    return out.select("doc_id", "author_id", F.round("delta", 6).alias("delta"), "rank")


def whole_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level changes of every paragraph that the rewrite touches, however long."""
    done = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP)
    out = diff.diff_paragraphs(rewrite.paragraph_rows(done), None)
    return out.select("doc_id", "para_idx", "n_changes", F.size(F.filter("ops", lambda o: o["op"] == "add")).alias("added"), F.size(F.filter("ops", lambda o: o["op"] == "del")).alias("deleted"))


def rule_seeds() -> list[str]:
    """A sentence for every rule of the default set that changes text, made from the rule."""
    rules = default_rules()
    out = [f"{phrase} they agree." for phrase in rules.deletes["sentenceStartDeletes"]]
    out += [f"They {phrase} agree." for phrase in rules.deletes["midSentenceDeletes"]]
    return out + [f"They will {find} it." if verb else f"They said {find} there." for swaps in rules.swaps.values() for find, _, verb in swaps]


def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last paragraph of every document after the rewrite; each holds one rule, and all rules come up in turn."""
    done = rewrite.rewrite_documents(with_seeds(table(spark, sf_dir, "documents"), rule_seeds()), default_rules(), sep=SEP)
    last = F.element_at("paragraphs", -1)
    return done.select("doc_id", last["original"].alias("seed"), last["output"].alias("output"), (F.size(last["changes"]) > 0).alias("changed"))


def joined_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from rows of paragraphs: their digests."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    return rewrite.join_paragraphs(paragraphs, SEP).select("doc_id", F.md5(F.col("output").cast("binary")).alias("output_md5"))


def class_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the readability of the quality classes lies apart."""
    scores = corpus.readability(table(spark, sf_dir, "documents")).select("doc_id", F.col("score").alias("total"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("class"))
    return corpus.class_separation(corpus.class_rates(scores, labels, 60.0)).withColumn("separation", F.round("separation", 6))


def projected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from the flags that are still open when the flag words at even places have been dealt with."""
    _, found = _review(spark, sf_dir)
    placed = found.filter("start is not null")
    handled = placed.filter("type = 'Word choice' and start % 2 = 0").select("doc_id", "para_idx", "type", "found", "start")
    return scoring.projected_score(placed, handled)


def invalid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of which every seventh is made wrong, and what the check says about them."""
    docs, found = _review(spark, sf_dir)
    scores = scoring.score_documents(docs, found)
    kind = F.pmod("doc_id", F.lit(14))
    spoiled = scores.withColumn("total", F.when(kind == 0, F.col("total") + 21).otherwise(F.col("total"))).withColumn("verdict", F.when(kind == 7, "human").otherwise(F.col("verdict")))
    return scoring.validate_scores(spoiled).select("doc_id", "total", "verdict", "failure")


def reverted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits in each first paragraph, the first one taken back in every other document."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    todo = F.explode(F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(0).alias("nth")) for seq, a, b in ((1, "e", "E1"), (2, "a", "A2"))]))
    edits = docs.select("doc_id", F.lit(0).alias("para_idx"), todo.alias("e")).select("doc_id", "para_idx", "e.*")
    kept = review.revert_edits(edits, edits.filter("seq = 1 and pmod(doc_id, 2) = 0"))
    out = review.replay_edits(paragraphs, kept).filter("para_idx = 0")
    return out.select("doc_id", F.md5(F.col("output").cast("binary")).alias("output_md5"), "n_edits", F.size("missing").alias("n_missing"))


def rewrite_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded last paragraphs as the rewrite leaves them with one of its switches off."""
    out = seeded(spark, sf_dir)
    for switch in ("expandContractions", "removeEmojis", "fixDashes"):
        rules = default_rules()
        rules.settings |= {switch: False}
        done = rewrite.rewrite_documents(out, rules, sep=SEP)
        out = done.withColumn(switch, F.element_at("paragraphs", -1)["output"]).drop("paragraphs")
    return out.select("doc_id", F.col("expandContractions").alias("contractions_stay"), F.col("removeEmojis").alias("emojis_stay"), F.col("fixDashes").alias("dashes_stay"))


def second_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a second rewrite of every seeded document: there are none."""
    once = rewrite.rewrite_documents(seeded(spark, sf_dir), default_rules(), sep=SEP).select("doc_id", rewrite.output_text(SEP).alias("text"))
    return rewrite.rewrite_documents(once, default_rules(), sep=SEP).select("doc_id", rewrite.change_count().alias("n_changes"))


def heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that open with the same word, three lines of every document being made headings."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    third = F.when(F.pmod("doc_id", F.lit(2)) == 1, "Same").otherwise("Other")
    head = F.concat(F.lit("# Same one\n## same two\n# "), third, F.lit(" three\n"), F.lit("# "), F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" x\n"))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(head, F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", F.explode(flags.document_flags(F.col("text"))).alias("f")).filter("f.excerpt like '%headings start%'")
    return rows.select("doc_id", "f.found", "f.excerpt")


def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First paragraphs written anew by hand in some documents, which takes their edits away; an empty one is refused."""
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    edits = docs.select("doc_id", F.lit(0).alias("para_idx"), F.lit(1).alias("seq"), F.lit("e").alias("from"), F.lit("E1").alias("to"), F.lit(0).alias("nth"))
    by_hand = docs.filter("doc_id % 5 < 2").select("doc_id", F.lit(0).alias("para_idx"), F.when(F.col("doc_id") % 5 == 0, "New\n \n\ntext").otherwise("  ").alias("text"))
    base, kept = review.manual_edits(paragraphs, edits, by_hand)
    return review.replay_edits(base, kept).filter("para_idx = 0").select("doc_id", F.md5(F.col("output").cast("binary")).alias("output_md5"), "n_edits")


def flag_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on offer instead of flag words, in the casing of the text."""
    rules = default_rules()
    rules.flags = [("of", "Marketing hype", "Cut", None, ["from", ""])]
    docs = table(spark, sf_dir, "documents")
    paragraphs = docs.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), SEP)).alias("para_idx", "output"))
    out = splits.suggest_options(flags.review_flags(paragraphs, rules), paragraphs, rules)
    return out.filter("scope = 'phrase'").select("doc_id", "para_idx", "start", "end", "label", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rewrite_categories, readability_documents, readability_by_group, rewrite_outputs, rewrite_stats, rule_usage, flag_types, flags_by_source, density_scores, audit_scores,
        review_work_list, replay_edits, sentence_metrics, document_metrics, rhythm_rules, section_windows, class_rates, class_thresholds, hardest_documents, gates, plain_text,
        flags_by_dimension, flag_rule_usage, document_statistics, score_before_after, recompute, rule_counts, stock_hits, guards, paragraph_diffs, split_candidates, split_report, style_distance, letter_language,
        sentence_spans, protected_spans, match_texts, irregularities, visible_flags,
        phrase_hits, flags_in_sentences, section_scores, highlights, mined_phrases, sketch_thresholds,
        incremental_scores, rewrite_stream, partitioned_results, sql_flags, split_seeds, nearest_authors, whole_diffs,
        rewrite_rules, joined_paragraphs, class_separation, projected_scores, invalid_scores, reverted_edits,
        rewrite_toggles, second_rewrite, heading_flags, manual_edits, flag_options,
    )
}

# ---------------------------------------------------------------------------------------------------
# SQL

_GUARD = r"""regexp_replace(regexp_replace({t}, '\b(e\.g|i\.e|etc|vs|Mr|Mrs|Ms|Dr|Inc|Ltd|St|No|Fig)\.', '\1' || chr(2), 'g'), '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g')"""
_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace(" + _GUARD + r", '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), "
    r"lambda s: regexp_replace(replace(s, chr(2), '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
)
_WORDS = "regexp_extract_all({t}, '[A-Za-z0-9''’-]+')"


def sentences_sql(t: str) -> str:
    return _SENTENCES.replace("{t}", t)


def words_sql(t: str) -> str:
    return _WORDS.replace("{t}", t)


_SYLLABLES = r"""list_sum(list_transform(list_transform({w}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w:
  CASE WHEN w = '' THEN 0 WHEN length(w) <= 3 THEN 1
  ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END))"""


def readability_sql(source: str, text: str = "text", name: str = "r") -> str:
    """CTE ``name`` (and one before it): every row of ``source`` with score, grade, words, sentences, avg_sentence."""
    w = words_sql("t")
    return f"""{name}0 AS (SELECT *, len({w}) AS nw, len({sentences_sql('t')}) AS ns, coalesce({_SYLLABLES.replace('{w}', w)}, 0) AS ny
  FROM (SELECT *, coalesce({text}, '') AS t FROM {source})),
{name} AS (SELECT *, CASE WHEN nw > 0 AND ns > 0 THEN floor((206.835::DOUBLE - 1.015::DOUBLE * (nw / ns) - 84.6::DOUBLE * (ny / nw)) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS score,
  CASE WHEN nw > 0 AND ns > 0 THEN floor((0.39::DOUBLE * (nw / ns) + 11.8::DOUBLE * (ny / nw) - 15.59::DOUBLE) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS grade,
  CASE WHEN nw > 0 AND ns > 0 THEN CAST(nw AS INT) ELSE 0 END AS words, CASE WHEN nw > 0 AND ns > 0 THEN CAST(ns AS INT) ELSE 0 END AS sentences,
  CASE WHEN nw > 0 AND ns > 0 THEN floor((nw / ns) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS avg_sentence FROM {name}0)"""


_SEED_TEXTS = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s, _, _ in SEEDS) + "]"
_SEED_OUTPUTS = "[" + ", ".join("'" + o.replace("'", "''") + "'" for _, o, _ in SEEDS) + "]"
_SEED_CHANGES = "(VALUES " + ", ".join(f"({i}, '{c}', {n})" for i, (_, _, changes) in enumerate(SEEDS) for c, n in changes.items()) + ") AS k(seed, category, n)"
_SEED_COUNTS = "[" + ", ".join(str(sum(c.values())) for _, _, c in SEEDS) + "]"
_N = len(SEEDS)
_NORMAL = r"regexp_replace(regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
#: What the passes do to a paragraph in which no rule matches: they tidy spaces and commas.
_TIDIED = r"{p}"
for _pattern, _by in [(" {2,}", " "), (" +([.,;:!?])", r"\1"), (r",\s*([.,;:!?])", r"\1"), (" {2,}", " "), (" ([.,;:!?])", r"\1"), (r",\s*,", ","), (" {2,}", " ")]:
    _TIDIED = f"regexp_replace({_TIDIED}, '{_pattern}', '{_by}', 'g')"
_PARTS = "CASE WHEN {n} = '' THEN [] ELSE string_split({n}, chr(10)) END"
#: What no rule may touch: code, addresses of pages and of mail.
_PROTECTED = r"`[^`\n]+`|\bhttps?://[^\s)>\]]+|\b[\w.+-]+@[\w-]+\.[\w.]+\b"
_MASKED = rf"regexp_replace(coalesce(text, ''), '{_PROTECTED}', chr(3) || '0' || chr(3), 'g')"
_PASSIVE = r"(?i)\b(am|is|are|was|were|been|being|be)\s+(\w+(?:ed|wn|en))\b(\s+by\b)?"
_BENIGN = r"(?i)\b(is|are|was|were)\s+(based|located|named|called|designed|used|expected|required|needed|allowed|limited)\b"
_TOKEN = "[A-Za-z][A-Za-z''-]*"


def _outputs_sql() -> str:
    tidied = _TIDIED.replace("{p}", "p")
    own = _PARTS.replace("{n}", _NORMAL.replace("{t}", "coalesce(text, '')"))
    return f"""docs AS (SELECT *, doc_id % {_N} AS seed, {own} AS parts FROM documents),
done AS (SELECT *, list_append(list_transform(parts, lambda p: {tidied}), {_SEED_OUTPUTS}[seed + 1]) AS outs, list_append(parts, {_SEED_TEXTS}[seed + 1]) AS ins FROM docs)"""


_FLAGS = f"""masked AS (SELECT doc_id, {_MASKED} AS m, text FROM documents),
parts AS (SELECT *, {sentences_sql('m')} AS s, list_transform(string_split(m, chr(10)), lambda p: {sentences_sql('p')}) AS ps FROM masked)"""



def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rule_values() -> str:
    rules = default_rules()
    rows = [(k, f) for k, swaps in rules.swaps.items() for f, _, _ in swaps] + [(k, p) for k, phrases in rules.deletes.items() for p in phrases]
    return ", ".join(f"({_quoted(k)}, {_quoted(f)})" for k, f in rows)


def _gram_sql(source: str) -> str:
    """Letter sequences of the rows of ``source(key, text)``, one row each."""
    padded = r"regexp_replace('_' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', '_', 'g') || '_', '_+', '_', 'g')"
    return f"SELECT key, unnest(list_transform(range(1, length(p) - 1), lambda i: p[i:i + 2])) AS gram FROM (SELECT key, {padded} AS p FROM {source})"


_FUNCTION_WORDS = ", ".join(map(_quoted, corpus.FUNCTION_WORDS))
_GOOD = "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"

ORACLE_SQL: dict[str, str] = {
    "readability_documents": f"WITH {readability_sql('documents')} SELECT doc_id, score, grade, words, sentences, avg_sentence FROM r",
    "readability_by_group": f"""WITH {readability_sql('documents')}
SELECT source, lang, count(*) AS docs, CAST(sum(words) AS BIGINT) AS words, round(avg(score), 4) AS avg_score, min(score) AS min_score, max(score) AS max_score, round(avg(grade), 4) AS avg_grade
FROM r GROUP BY source, lang""",
    "rewrite_categories": f"""WITH k AS (SELECT * FROM {_SEED_CHANGES}), fine AS (
  SELECT source, category, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT doc_id) AS docs FROM documents JOIN k ON doc_id % {_N} = seed GROUP BY source, category)
SELECT source, category, n, docs FROM fine UNION ALL SELECT NULL, category, CAST(sum(n) AS BIGINT), CAST(sum(docs) AS BIGINT) FROM fine GROUP BY category""",
    "rewrite_outputs": f"""WITH {_outputs_sql()}
SELECT doc_id, md5(array_to_string(outs, chr(10))) AS output_md5, {_SEED_COUNTS}[seed + 1] AS n_changes, CAST(len(outs) AS INT) AS n_paragraphs FROM done""",
    "rewrite_stats": f"""WITH {_outputs_sql()}, b AS (SELECT doc_id, seed, array_to_string(ins, chr(10)) AS text FROM done), a AS (SELECT doc_id, array_to_string(outs, chr(10)) AS text FROM done),
{readability_sql('b')}, {readability_sql('a', name='q')}
SELECT r.doc_id, r.score AS score_before, q.score AS score_after, {_SEED_COUNTS}[r.seed + 1] AS change_count, r.words - q.words AS words_saved FROM r JOIN q USING (doc_id)""",
    "flag_types": rf"""WITH {_FLAGS}
SELECT doc_id, CAST(len(regexp_extract_all(m, '(?i)\bof\b')) + len(regexp_extract_all(m, '(?i)\bis\b')) AS INT) AS word_choice,
  CAST(len(list_filter(s, lambda x: len({words_sql('x')}) > 28)) AS INT) AS long_sentence,
  CAST(len(list_filter(s, lambda x: regexp_matches(x, '{_PASSIVE}') AND (NOT regexp_matches(regexp_extract(x, '{_PASSIVE}', 0), '{_BENIGN}') OR regexp_extract(x, '{_PASSIVE}', 3) <> ''))) AS INT) AS passive_voice,
  CAST(len(list_filter(s, lambda x: contains(x, ';'))) AS INT) AS semicolon,
  CAST(len(list_filter(ps, lambda p: len(p) > 6)) AS INT) AS long_paragraph,
  CAST(coalesce(list_sum(list_transform(ps, lambda p: len(list_filter(map_values(list_histogram(list_transform(list_filter(list_transform(p, lambda x: {words_sql('x')}), lambda w: len(w) >= 2), lambda w: lower(w[1] || ' ' || w[2])))), lambda n: n >= 3)))), 0)
    + CASE WHEN len(regexp_extract_all(m, '(?:^|[.!?]\s+)(?:Also|However|So),?\s')) >= 3 THEN 1 ELSE 0 END AS INT) AS repetitive_rhythm
FROM parts""",
    "flags_by_source": "",
    "density_scores": rf"""WITH masked AS (SELECT doc_id, {_MASKED} AS m, len({words_sql("coalesce(text, '')")}) AS n FROM documents), f AS (
  SELECT *, len(regexp_extract_all(m, '(?i)\bof\b')) AS a, len(regexp_extract_all(m, '(?i)\bis\b')) AS b FROM masked)
SELECT doc_id, CAST(n AS INT) AS n_words, least(4.0::DOUBLE, floor(CASE WHEN n > 0 THEN a * 1000.0::DOUBLE / n ELSE 0 END / 9 * 4 * 2 + 0.5::DOUBLE) / 2) AS d1,
  least(4.0::DOUBLE, floor(CASE WHEN n > 0 THEN b * 1000.0::DOUBLE / n ELSE 0 END / 9 * 4 * 2 + 0.5::DOUBLE) / 2) AS d3 FROM f""",
    "rule_usage": f"""WITH rules(list, find) AS (VALUES {_rule_values()}), fired(seed, list, find) AS (VALUES {", ".join(f"({i}, {_quoted(k)}, {_quoted(f)})" for i, k, f in SEED_RULES)}),
hits AS (SELECT list, find, count(*) AS n FROM documents JOIN fired ON doc_id % {_N} = seed GROUP BY ALL)
SELECT list, find, coalesce(n, 0) AS hits, coalesce(n, 0) AS docs FROM rules LEFT JOIN hits USING (list, find)""",
    "letter_language": f"""WITH good AS (SELECT lang AS key, text FROM ({_GOOD}) WHERE lang IS NOT NULL), own AS (SELECT doc_id AS key, text FROM documents),
p AS (SELECT key AS lang, gram, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, gram) AS rank FROM ({_gram_sql("good")}) GROUP BY key, gram),
d AS (SELECT key AS doc_id, gram, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, gram) AS own_rank FROM ({_gram_sql("own")}) GROUP BY key, gram),
g AS (SELECT doc_id, lang, sum(abs(own_rank - rank) - 300) AS gain FROM d JOIN p USING (gram) WHERE rank <= 300 AND own_rank <= 300 GROUP BY doc_id, lang),
b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY gain, lang) AS k FROM g)
SELECT doc_id, b.lang AS lang_pred FROM documents LEFT JOIN b USING (doc_id) WHERE coalesce(k, 1) = 1""",
    "style_distance": f"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)*') AS w FROM documents), total AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, word, count(*) / size AS rate FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM w) WHERE word IN ({_FUNCTION_WORDS}) GROUP BY doc_id, word, size),
s AS (SELECT word, sqrt(greatest(0, sum(rate * rate) / n - (sum(rate) / n) * (sum(rate) / n))) AS dev FROM r, total GROUP BY word, n),
good AS ({_GOOD}), samples AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
a AS (SELECT lang, word, sum(rate) / n AS author_rate FROM r JOIN good USING (doc_id) JOIN samples USING (lang) GROUP BY lang, word, n),
grid AS (SELECT doc_id, samples.lang AS author_id, word, dev FROM documents, samples, s WHERE dev > 0)
SELECT doc_id, author_id, round(avg(abs(coalesce(rate, 0) - coalesce(author_rate, 0)) / dev), 6) AS delta
FROM grid LEFT JOIN r USING (doc_id, word) LEFT JOIN a ON a.lang = author_id AND a.word = grid.word GROUP BY doc_id, author_id""",
    "replay_edits": f"""WITH d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))} AS parts FROM documents),
p AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INT) AS para_idx, unnest(parts) AS t FROM d)
SELECT doc_id, para_idx, md5(CASE WHEN para_idx = 0 AND instr(t, 'the') > 0 THEN t[:instr(t, 'the') - 1] || 'THE' || t[instr(t, 'the') + 3:] ELSE t END) AS output_md5,
  CASE WHEN para_idx = 0 THEN 1 ELSE 0 END AS n_edits, CASE WHEN para_idx = 0 AND instr(t, 'the') = 0 THEN 1 ELSE 0 END AS n_missing FROM p""",
    "sentence_metrics": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (
  SELECT *, list_transform({sentences_sql('t')}, lambda x: len(regexp_extract_all(x, '{_TOKEN}'))) AS l, {_PARTS.replace('{n}', _NORMAL.replace('{t}', 't'))} AS p FROM d), m AS (
  SELECT *, list_sum(l) / len(l) AS mean FROM e), v AS (SELECT *, sqrt(list_sum(list_transform(l, lambda x: (x - mean) * (x - mean))) / len(l)) AS dev FROM m)
SELECT doc_id, CAST(len(regexp_extract_all(t, '{_TOKEN}')) AS INT) AS words, CAST(len(l) AS INT) AS sentences, CAST(len(p) AS INT) AS paragraphs,
  CAST(coalesce(list_min(l), 0) AS INT) AS sent_len_min, CAST(coalesce(list_max(l), 0) AS INT) AS sent_len_max, round(coalesce(mean, 0), 6) AS sent_len_mean, round(coalesce(dev, 0), 6) AS sent_len_stdev,
  round(CASE WHEN mean > 0 THEN dev / mean ELSE 0 END, 6) AS sent_len_cv, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: x < 8)) / len(l) ELSE 0 END, 6) AS short_sent_rate,
  round(CASE WHEN mean > 0 AND len(l) > 1 THEN list_sum(list_transform(range(1, len(l)), lambda i: abs(l[i + 1] - l[i]))) / (len(l) - 1) / mean ELSE 0 END, 6) AS burstiness FROM v""",
    "section_windows": f"""WITH d AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents WHERE len({words_sql('text')}) > 1200),
x AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS t FROM d), n AS (SELECT doc_id, i, len({words_sql('t')}) AS n FROM x),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, CAST(floor(before / 400) AS INT) AS section, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_sentences FROM w GROUP BY ALL""",
    "class_rates": f"""WITH {readability_sql('documents')} SELECT CAST(quality AS VARCHAR) AS class, count(*) AS docs, round(avg(CASE WHEN score >= 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS over,
  round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS stdev, min(score) AS least, max(score) AS greatest FROM r JOIN labels USING (doc_id) GROUP BY quality""",
    "class_thresholds": f"""WITH {readability_sql('documents')}, q AS (SELECT CAST(quality AS VARCHAR) AS class, quantile_cont(score, [0.05, 0.5, 0.95]) AS v FROM r JOIN labels USING (doc_id) GROUP BY quality)
SELECT class, unnest([0.05::DOUBLE, 0.5, 0.95]) AS share, round(unnest(v), 6) AS threshold FROM q""",
    "hardest_documents": f"""WITH {readability_sql('documents')}, k AS (SELECT source, doc_id, grade, CAST(row_number() OVER (PARTITION BY source ORDER BY grade DESC, doc_id) AS INT) AS rank FROM r)
SELECT * FROM k WHERE rank <= 5""",
    "gates": f"""SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE 'Language is ' || coalesce(lang, 'unknown') || ', not en' END AS reason, CAST(n AS INT) AS n_words,
  CASE WHEN n < 150 THEN 'insufficient' WHEN n < 400 THEN 'short' END AS length_guard, coalesce(length(text) > 5000, false) AS truncated, CAST(length(text[:5000]) AS INT) AS n_kept
FROM (SELECT *, len({words_sql("coalesce(text, '')")}) AS n FROM documents)""",
    "rule_counts": r"""WITH p AS (SELECT unnest(['of the', 'with', 'est', 'und', 'de la']) AS phrase),
c AS (SELECT doc_id, phrase, CAST(len(regexp_extract_all(coalesce(text, ''), '(?i)\b' || phrase || '\b')) AS INT) AS n FROM documents, p)
SELECT doc_id, phrase, n FROM c WHERE n > 0""",
    "stock_hits": r"""WITH p AS (SELECT unnest(['of the', 'with']) AS phrase),
c AS (SELECT doc_id, phrase, CAST(len(regexp_extract_all(text, '(?i)\b' || phrase || '\b')) AS INT) AS n, regexp_extract(text, '(?i)(?s)^(.*?)\b' || phrase || '\b', 1) AS before FROM documents, p)
SELECT doc_id, phrase, n, CAST(length(before) AS INT) AS first FROM c WHERE n > 0""",
    "plain_text": r"""WITH b AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM conversations)
SELECT conv_id, turn, CAST(len(p) AS INT) AS n_blocks, md5(array_to_string(list_transform(p, lambda x: regexp_replace(replace(regexp_replace(x, '^#{1,6}\s+', ''), chr(10), ' '), '\*\*([^*]+)\*\*', '\1', 'g')), chr(10) || chr(10))) AS plain_md5 FROM b""",
}
#: Flags by type out of the numbers per document; no default flag word occurs.
ORACLE_SQL["flags_by_source"] = f"""WITH t AS ({ORACLE_SQL["flag_types"]}), u AS (
  SELECT source, unnest(['Long sentence', 'Passive voice', 'Semicolon', 'Long paragraph', 'Repetitive rhythm']) AS type,
    unnest([long_sentence, passive_voice, semicolon, long_paragraph, repetitive_rhythm]) AS n FROM t JOIN documents USING (doc_id)),
fine AS (SELECT source, type, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM u WHERE n > 0 GROUP BY source, type)
SELECT source, type, n, docs FROM fine UNION ALL SELECT NULL, type, CAST(sum(n) AS BIGINT), CAST(sum(docs) AS BIGINT) FROM fine GROUP BY type"""

# Flags of review, with offsets. Places of matches come from what lies between them.
_PERCENT = r"(?:^|[^\w.])\d+(?:\.\d+)?(?:%| percent\b)"


def _spans_sql(text: str, pattern: str) -> str:
    """List of {a, b, f}: where a pattern's matches in ``text`` begin and end, and what they are."""
    parts, found = f"string_split_regex({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    start = f"CAST(list_sum(list_transform({parts}[:i], lambda y: length(y))) + coalesce(list_sum(list_transform({found}[:i - 1], lambda y: length(y))), 0) AS INT)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'a': {start}, 'b': CAST({start} + length({found}[i]) AS INT), 'f': {found}[i]}})"


def _found_sql(source: str, words: dict[str, str], name: str = "found") -> str:
    """CTE ``name`` (and some before it): review flags of the texts of ``source(doc_id, text)``; ``words`` are flag
    words with their dimensions."""
    free = "len(list_filter(safe, lambda m: m.a < e AND a < m.b)) = 0"
    flagged = " UNION ALL ".join(f"SELECT doc_id, para_idx, safe, '{d}' AS dim, unnest({_spans_sql('t', rf'(?i)\b{w}\b')}) AS w FROM {name}_p" for w, d in words.items())
    pieces = "string_split(regexp_replace(" + _GUARD.replace("{t}", "t") + r", '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"""{name}_0 AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))} AS ts FROM {source}),
{name}_1 AS (SELECT doc_id, CAST(unnest(range(len(ts))) AS INT) AS para_idx, unnest(ts) AS t FROM {name}_0),
{name}_p AS (SELECT *, {_spans_sql('t', _PROTECTED)} AS safe, {pieces} AS pc FROM {name}_1),
{name}_2 AS (SELECT doc_id, para_idx, t, safe, unnest(list_transform(range(1, len(pc) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(pc[:i - 1], lambda y: length(y))), 0), 'x': replace(pc[i], chr(2), '.')}})) AS z FROM {name}_p),
{name}_s AS (SELECT doc_id, para_idx, t, safe, CAST(z.a + length(regexp_extract(z.x, '^\s*')) AS INT) AS loc, regexp_replace(z.x, '^\s+|\s+$', '', 'g') AS s FROM {name}_2 WHERE regexp_matches(z.x, '\S')),
{name}_n AS (SELECT *, len({words_sql('s')}) AS n, {words_sql('s')}[:2] AS head FROM {name}_s),
{name}_w AS ({flagged}),
{name}_q AS (SELECT doc_id, para_idx, t, safe, unnest({_spans_sql('t', _PERCENT)}) AS w FROM {name}_p),
{name}_m AS (SELECT doc_id, para_idx, t, safe, CAST(w.a + length(regexp_extract(w.f, '^[^0-9]')) AS INT) AS a, w.b AS e, regexp_replace(w.f, '^[^0-9]', '') AS f FROM {name}_q),
{name}_v AS (SELECT *, CAST(loc + length(string_split_regex(s, '{_PASSIVE}')[1]) AS INT) AS a, CAST(loc + length(string_split_regex(s, '{_PASSIVE}')[1]) + length(regexp_extract(s, '{_PASSIVE}', 0)) AS INT) AS e,
  regexp_extract(s, '{_PASSIVE}', 0) AS f FROM {name}_n WHERE NOT regexp_matches(s, '^#{{1,6}}\s') AND regexp_matches(s, '{_PASSIVE}')
  AND (NOT regexp_matches(regexp_extract(s, '{_PASSIVE}', 0), '{_BENIGN}') OR regexp_extract(s, '{_PASSIVE}', 3) <> '') AND lower(regexp_extract(s, '{_PASSIVE}', 1)) <> 'is'),
{name} AS (
  SELECT doc_id, para_idx, a AS start, e AS "end", 'Word choice' AS type, dim, f AS found, 'advice' AS kind FROM (SELECT *, w.a AS a, w.b AS e, w.f AS f FROM {name}_w) WHERE {free}
  UNION ALL SELECT doc_id, para_idx, a, e, 'Missing specifics', 'd4', f, 'advice' FROM {name}_m WHERE {free}
    AND NOT regexp_matches(regexp_extract(t[e + 1:], '^(?:[^.]|\.\S)*'), '(?i)\b(?:according|source|survey|report|study)\b')
  UNION ALL SELECT doc_id, para_idx, loc, CAST(loc + length(s) AS INT), 'Long sentence', 'd2', n || ' words', 'advice-span' FROM {name}_n WHERE n > 28 AND NOT regexp_matches(s, '^#{{1,6}}\s')
  UNION ALL SELECT doc_id, para_idx, a, e, 'Passive voice', 'd3', f, 'advice' FROM {name}_v WHERE {free}
  UNION ALL SELECT doc_id, para_idx, CAST(loc + w.a AS INT), CAST(loc + w.b AS INT), 'Semicolon', 'd2', ';', 'advice'
    FROM (SELECT doc_id, para_idx, loc, unnest({_spans_sql('s', ';')}) AS w FROM {name}_n WHERE NOT regexp_matches(s, '^#{{1,6}}\s'))
  UNION ALL SELECT doc_id, para_idx, 0, CAST(length(t) AS INT), 'Long paragraph', 'd2', count(*) || ' sentences', 'advice-span' FROM {name}_n WHERE NOT regexp_matches(t, '^\s*#') GROUP BY doc_id, para_idx, t HAVING count(*) > 6
  UNION ALL SELECT doc_id, para_idx, 0, CAST(length(t) AS INT), 'Repetitive rhythm', 'd2', count(*) || ' sentences start with "' || lower(head[1] || ' ' || head[2]) || '"', 'advice-span'
    FROM {name}_n WHERE len(head) = 2 AND NOT regexp_matches(t, '^\s*#') GROUP BY doc_id, para_idx, t, lower(head[1] || ' ' || head[2]) HAVING count(*) >= 3
  UNION ALL SELECT doc_id, NULL, NULL, NULL, 'Repetitive rhythm', 'd2', n || ' occurrences', 'document'
    FROM (SELECT doc_id, len(regexp_extract_all(text, '(?:^|[.!?]\s+)(?:Also|However|So),?\s')) AS n FROM {source}) WHERE n >= 3)"""


def _density_sql(n: str) -> str:
    return f"least(4.0::DOUBLE, floor(CASE WHEN n_words > 0 THEN {n} * 1000.0::DOUBLE / n_words ELSE 0 END / 9 * 4 * 2 + 0.5::DOUBLE) / 2)"


_SIGNS = [
    r"\b(?:[Ii]|[Mm]y|[Mm]e|[Mm]ine|[Ww]e|[Oo]ur|[Uu]s)\b",
    r"\b(?:(?:19|20)\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b",
    r"(?:^|[^\w.])\d+(?:[.,]\d+)+\b|(?:^|[^\w.])\d*[1-46-9]\b|[$€£]\d",
    r"\b(?:I|we) (?:think|believe|prefer|doubt|hope|like|hate|love|regret|disagree)\b|\b(?:Mr|Mrs|Ms|Dr)\. [A-Z]|[a-z,] [A-Z][a-z]+ [A-Z][a-z]+",
]


def _scores_sql(source: str, words: dict[str, str], name: str = "scored") -> str:
    """CTE ``name`` (and some before it): doc_id, n_words, d1 to d5, total, verdict, weighted, of ``source(doc_id, text)``."""
    signs = " - ".join(f"CAST(regexp_matches(coalesce(text, ''), '{p}') AS INT)" for p in _SIGNS)
    counts = ", ".join(f"count(*) FILTER (dim = '{d}') AS n_{d}" for d in ("d1", "d2", "d3", "d4"))
    dims = ", ".join(f"{_density_sql(f'coalesce(n_{d}, 0)')} AS {d}" for d in ("d1", "d2", "d3", "d4"))
    return f"""{_found_sql(source, words, f'{name}_found')}, {name}_c AS (SELECT doc_id, {counts} FROM {name}_found GROUP BY doc_id),
{name}_t AS (SELECT doc_id, CAST(len({words_sql("coalesce(text, '')")}) AS INT) AS n_words, CAST(4 - {signs} AS DOUBLE) AS d5 FROM {source}),
{name}_d AS (SELECT doc_id, n_words, {dims}, d5 FROM {name}_t LEFT JOIN {name}_c USING (doc_id)),
{name}_e AS (SELECT *, floor((d1 + d2 + d3 + d4 + d5) * 10 + 0.5::DOUBLE) / 10 AS total,
  floor((d1 * 0.75::DOUBLE + d2 * 1.25::DOUBLE + d3 + d4 * 1.25::DOUBLE + d5 * 0.75::DOUBLE) * 10 + 0.5::DOUBLE) / 10 AS weighted_total FROM {name}_d),
{name} AS (SELECT *, CASE WHEN total >= 15 THEN 'heavy' WHEN total >= 10 THEN 'moderate' WHEN total >= 6 THEN 'light' WHEN total > 0 THEN 'low' ELSE 'none' END AS verdict FROM {name}_e)"""


_OWN = {"of": "d1", "is": "d3"}
_BANDS = "CASE WHEN n_words < 150 THEN 'insufficient_text' WHEN weighted_total <= 4 THEN 'human-written' WHEN weighted_total <= 8.5 THEN 'mild' WHEN weighted_total <= 13.5 THEN 'substantial' ELSE 'heavy' END"
_TEXTS = f"{_outputs_sql()}, b AS (SELECT doc_id, seed, array_to_string(ins, chr(10)) AS text FROM done), a AS (SELECT doc_id, array_to_string(outs, chr(10)) AS text FROM done)"


def _phrases(names: list[str]) -> str:
    return r"\b(?:" + "|".join(n.replace("'", "''") for n in names) + r")\b"


def _stdev_sql(a: str) -> str:
    return f"CASE WHEN len({a}) > 1 THEN sqrt(list_sum(list_transform({a}, lambda x: (x - list_avg({a})) * (x - list_avg({a})))) / len({a})) ELSE 0 END"


def _per(count: str, unit: int = 1000) -> str:
    return f"CASE WHEN n > 0 THEN {count} * {unit}.0::DOUBLE / n ELSE 0 END"


def _count(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


_NUMERAL = r"(?:$|[.,](?:$|[^0-9]))"
_BULLET = r"^\s*(?:[-*+]|[0-9]+[.)])\s"
_CLAIM = "(?i)" + _phrases(metrics.AUTHORITY)
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Metrics of every document, unrounded.
_METRICS = rf"""{readability_sql('documents')}, e0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e1 AS (SELECT *, len(regexp_extract_all(t, '{_TOKEN}')) AS n, {sentences_sql('t')} AS sents, {_PARTS.replace('{n}', _NORMAL.replace('{t}', 't'))} AS p, string_split(t, chr(10)) AS rows,
  string_split_regex(t, '[''’]') AS around, string_split(t, ' ') AS spaced, regexp_extract_all(lower(t), '{_TOKEN}') AS low FROM e0),
e2 AS (SELECT *, list_transform(sents, lambda x: len(regexp_extract_all(x, '{_TOKEN}'))) AS l, list_transform(p, lambda y: len({sentences_sql('y')})) AS per_p,
  list_transform(list_filter(string_split_regex(t, '(?m)^#{{1,6}}\s+.*$'), lambda x: regexp_matches(x, '\S')), lambda x: len(regexp_extract_all(x, '{_TOKEN}'))) AS sec,
  list_filter(rows, lambda x: regexp_matches(x, '{_BULLET}')) AS bullets, regexp_extract_all(t, '[\w.,]+') AS runs, string_split_regex(t, '{_CLAIM}') AS claims,
  list_transform(list_filter(list_transform(sents, lambda x: {words_sql('lower(x)')}[:3]), lambda w: len(w) = 3), lambda w: array_to_string(w, ' ')) AS heads FROM e1),
e3 AS (SELECT *, list_sum(l) / len(l) AS mean, sqrt(list_sum(list_transform(l, lambda x: (x - list_avg(l)) * (x - list_avg(l)))) / len(l)) AS dev,
  list_distinct(regexp_extract_all(lower(p[-1]), '[a-z]{{5,}}')) AS own, regexp_extract_all(lower(array_to_string(p[:len(p) - 1], ' ')), '[a-z]{{5,}}') AS earlier FROM e2),
mt AS (SELECT doc_id, CAST(n AS INT) AS words, CAST(len(sents) AS INT) AS sentences, CAST(len(p) AS INT) AS paragraphs,
  CAST(coalesce(mean, 0) AS DOUBLE) AS sent_len_mean, coalesce(dev, 0) AS sent_len_stdev, CASE WHEN mean > 0 THEN dev / mean ELSE 0 END AS sent_len_cv,
  CAST(coalesce(list_min(l), 0) AS INT) AS sent_len_min, CAST(coalesce(list_max(l), 0) AS INT) AS sent_len_max,
  CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: x < 8)) / len(l) ELSE 0 END AS short_sent_rate,
  CASE WHEN mean > 0 AND len(l) > 1 THEN list_sum(list_transform(range(1, len(l)), lambda i: abs(l[i + 1] - l[i]))) / (len(l) - 1) / mean ELSE 0 END AS burstiness,
  sents[list_position(l, list_min(l))] AS shortest, sents[list_position(l, list_max(l))] AS longest,
  {_stdev_sql('per_p')} AS para_len_stdev, CASE WHEN list_sum(sec) > 0 THEN ({_stdev_sql('sec')}) * len(sec) / list_sum(sec) ELSE 0 END AS section_len_cv, CAST(len(sec) AS INT) AS sections,
  {_per(_count('(?i)' + _phrases(metrics.STOCK)))} AS stock_density,
  CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: list_contains([{', '.join(map(_quoted, metrics.TRANSITIONS))}], lower(regexp_extract(x, '^[^A-Za-z]*([A-Za-z]+)', 1))))) / len(p) ELSE 0 END AS transition_open_rate,
  {_per(_count(r'(?i)\b[a-z]+, [a-z]+,? and [a-z]+\b'))} AS tricolon_density, {_per(_count('—'))} AS em_dash_rate, {_per(_count(r'—[^—.!?\n]+—'))} AS paired_em_dash_rate,
  {_per(_count('(?i)' + _phrases(metrics.HEDGES)), 100)} AS hedge_density,
  {_per(_count('(?i)' + _phrases(['i', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours'])))} AS first_person_rate, {_per(_count('(?i)' + _phrases(['you', 'your', 'yours'])))} AS second_person_rate,
  CAST({_count(r"(?i)\bnot (?:just|only|merely)\s[^.!?;]{1,80}?[,;]?\s(?:but|it''s|it is)\b")} AS INT) AS not_just_count,
  CASE WHEN len(sents) > 0 THEN len(list_filter(sents, lambda x: regexp_matches(x, '^(?:While|Although|Though|Not only|Whereas)\b|, yet ,?'))) / len(sents) ELSE 0 END AS balanced_clause_rate,
  coalesce(len(p) > 1 AND regexp_matches(p[-1], '(?i)^{_phrases(metrics.SUMMARY_OPENERS)}') AND len(list_intersect(own, earlier)) > 0.6::DOUBLE * len(own), false) AS closing_restatement,
  CASE WHEN len(bullets) > 0 THEN len(list_filter(bullets, lambda x: regexp_matches(x, '^\s*(?:[-*+]|[0-9]+[.)])\s+\*\*(?:[^*]+\*\*\s*:|[^*]+:\*\*)'))) / len(bullets) ELSE 0 END AS bold_lead_bullet_rate,
  CAST(r.grade AS DOUBLE) AS flesch_kincaid,
  CASE WHEN len(heads) > 0 THEN (len(heads) - len(list_filter(map_values(list_histogram(heads)), lambda x: x = 1))) / len(heads) ELSE 0 END AS opener_repetition_rate,
  {_per("len(list_filter(range(1, len(around)), lambda i: regexp_matches(around[i], '(?i)[a-z]$') AND regexp_matches(around[i + 1], '(?i)^(?:s|t|re|ve|ll|d|m)(?:[^a-z]|$)')))")} AS contraction_rate,
  {_per(f"len(list_filter(runs, lambda x: regexp_matches(x, '^[0-9]+{_NUMERAL}')))")} AS numeral_density,
  {_per(f"len(list_filter(runs, lambda x: regexp_matches(x, '^[0-9]*[05]{_NUMERAL}')))")} AS round_numeral_density,
  {_per(_count(rf'\b(?:(?:19|20)[0-9]{{2}}|[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|(?:{_MONTHS}) [0-9]{{1,2}})\b'))} AS date_density,
  {_per("len(list_filter(range(1, len(spaced)), lambda i: regexp_matches(spaced[i], '[a-z0-9,;:)]$') AND regexp_matches(spaced[i + 1], '^[A-Z]')))")} AS capitalized_density,
  CASE WHEN n = 0 THEN 0 WHEN n <= 100 THEN len(list_distinct(low)) / n ELSE list_sum(list_transform(range(1, n - 98), lambda i: len(list_distinct(low[i:i + 99])))) / 100 / (n - 99) END AS mattr,
  CAST(len(list_filter(range(2, len(claims) + 1), lambda i: NOT regexp_matches(array_to_string(regexp_extract_all(array_to_string(claims[i:], ' '), '\S+')[:15], ' '), '\[\d+\]|\((?:19|20)\d\d\)|\b(?:19|20)\d\d\b|\b[A-Z][a-z]+'))) AS INT) AS authority_claims
  FROM e3 JOIN (SELECT doc_id, grade FROM r) AS r USING (doc_id))"""


def _fired(rules: list[tuple[str, str]], by: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + f"], lambda x: x IS NOT NULL), '{by}')"


_RHYTHM = [
    ("low variation", "sent_len_cv < 0.45::DOUBLE"), ("low oscillation", "burstiness < 0.35::DOUBLE"), ("transitions", "transition_open_rate > 0.35::DOUBLE"), ("tricolons", "tricolon_density > 4"),
    ("closing restatement", "closing_restatement"), ("equal sections", "section_len_cv < 0.25::DOUBLE AND sections >= 3"),
]
_GUARDS = [
    ("G-5", "words < 400"), ("G-3", "section_len_cv < 0.15::DOUBLE AND sections >= 3"), ("G-6", "hype > 0 AND hype / (hype + filler) > 0.5::DOUBLE"),
    ("G-2", "words > 0 AND greatest(academic, legal) * 1000.0::DOUBLE / words >= 40"), ("G-7", "coalesce(nearest <= 0.8::DOUBLE, false)"),
]

ORACLE_SQL |= {
    "audit_scores": f"WITH {_scores_sql('documents', _OWN)} SELECT doc_id, n_words, d1, d2, d3, d4, d5, total, verdict, weighted_total, {_BANDS} AS band FROM scored",
    "review_work_list": f"""WITH {_found_sql('documents', _OWN)}
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, para_idx, found ORDER BY start) - 1 AS INT) AS nth,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx NULLS LAST, start NULLS LAST, type, found) AS INT) AS position, count(*) OVER (PARTITION BY doc_id) AS n FROM found""",
    "flags_by_dimension": f"""WITH {_found_sql('documents', _OWN)}
SELECT source, dim, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(grouping(source) AS INT) AS all_groups, CAST(grouping(dim) AS INT) AS all_dims FROM found JOIN documents USING (doc_id) GROUP BY CUBE (source, dim)""",
    "flag_rule_usage": rf"""WITH m AS (SELECT {_MASKED} AS m FROM documents), w AS (SELECT unnest(['of', 'is', 'zzyzx']) AS find),
c AS (SELECT find, len(regexp_extract_all(m, '(?i)\b' || find || '\b')) AS n FROM m, w)
SELECT find, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS docs FROM c GROUP BY find""",
    "document_statistics": f"""WITH {_TEXTS}, {readability_sql('b')}, {readability_sql('a', name='q')},
f AS ({ORACLE_SQL["flag_types"].replace("FROM documents", "FROM a")})
SELECT r.doc_id, r.grade AS grade_before, q.grade AS grade_after, {_SEED_COUNTS}[r.seed + 1] AS change_count,
  word_choice + long_sentence + passive_voice + semicolon + long_paragraph + repetitive_rhythm AS flag_count, r.words - q.words AS words_saved FROM r JOIN q USING (doc_id) JOIN f USING (doc_id)""",
    "score_before_after": f"""WITH {_TEXTS}, {_scores_sql('b', _OWN | {'utilize': 'd1'}, 'x')}, {_scores_sql('a', _OWN | {'utilize': 'd1'}, 'y')}
SELECT x.doc_id, {', '.join(f'{s}.{k} AS {k}_{n}' for s, n in (('x', 'before'), ('y', 'after')) for k in ('d1', 'd2', 'd3', 'd4', 'd5', 'total', 'verdict'))} FROM x JOIN y USING (doc_id)""",
    "recompute": f"""WITH d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))} AS ts FROM documents),
o AS (SELECT doc_id, array_to_string(list_prepend(ts[1][:instr(ts[1], ' of ') - 1] || ' by ' || ts[1][instr(ts[1], ' of ') + 4:], ts[2:]), chr(10)) AS text FROM d WHERE instr(ts[1], ' of ') > 0),
{_scores_sql('o', _OWN)} SELECT doc_id, CAST(1 AS BIGINT) AS n_edits, n_words, d1, d2, d3, d4, d5, total, verdict FROM scored""",
    "document_metrics": f"WITH {_METRICS} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in ('sent_len_mean', 'sent_len_stdev', 'sent_len_cv', 'short_sent_rate', 'burstiness', 'para_len_stdev', 'section_len_cv', 'stock_density', 'transition_open_rate', 'tricolon_density', 'em_dash_rate', 'paired_em_dash_rate', 'hedge_density', 'first_person_rate', 'second_person_rate', 'balanced_clause_rate', 'bold_lead_bullet_rate', 'flesch_kincaid', 'opener_repetition_rate', 'contraction_rate', 'numeral_density', 'round_numeral_density', 'date_density', 'capitalized_density', 'mattr'))}) FROM mt",
    "rhythm_rules": f"WITH {_METRICS}, f AS (SELECT doc_id, {_fired(_RHYTHM, ', ')} AS d2_rules FROM mt) SELECT doc_id, d2_rules, CAST(least(4, CASE WHEN d2_rules = '' THEN 0 ELSE len(string_split(d2_rules, ', ')) END) AS INT) AS d2 FROM f",
    "guards": rf"""WITH {_METRICS}, sd AS ({ORACLE_SQL["style_distance"]}), near AS (SELECT doc_id, min(delta) AS nearest FROM sd GROUP BY doc_id),
x AS (SELECT doc_id, len(regexp_extract_all({_MASKED}, '(?i)\bof\b')) AS hype, len(regexp_extract_all({_MASKED}, '(?i)\bthe\b')) AS filler,
  coalesce(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w = 'of')), 0) AS academic, coalesce(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w = 'herein')), 0) AS legal FROM documents),
g AS (SELECT doc_id, words, {_fired(_GUARDS, ',')} AS guards FROM mt JOIN x USING (doc_id) LEFT JOIN near USING (doc_id))
SELECT doc_id, guards, CASE WHEN words < 150 THEN 'low' ELSE ['low', 'moderate', 'high'][greatest(0, least(2, 1 - CAST(words < 400 AS INT) - CAST(guards <> '' AS INT) + CAST(words > 1500 AS INT))) + 1] END AS confidence FROM g""",
    "paragraph_diffs": rf"""WITH {_outputs_sql()}, k(seed, n_changes, added, deleted) AS (VALUES (0, 2, 1, 2), (1, 2, 1, 2), (2, 1, 1, 1), (3, 1, 1, 1), (5, 3, 2, 3), (8, 2, 2, 2), (9, 1, 1, 1)),
x AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS p, unnest(outs[:len(parts)]) AS o FROM done),
y AS (SELECT *, regexp_extract_all(p, '\S+') AS a, regexp_extract_all(o, '\S+') AS b, greatest(len(regexp_extract_all(p, '\s+|\S+')), len(regexp_extract_all(o, '\s+|\S+'))) > 800 AS long FROM x WHERE p <> o),
z AS (SELECT *, list_filter(range(1, len(a) + 1), lambda j: a[j] IS DISTINCT FROM b[j]) AS c FROM y),
w AS (SELECT *, CAST(len(list_filter(c, lambda j: NOT list_contains(c, j - 1))) AS INT) AS n FROM z)
SELECT doc_id, CAST(len(parts) AS INT) AS para_idx, n_changes, added, deleted FROM done JOIN k USING (seed)
UNION ALL SELECT doc_id, CAST(i AS INT), CASE WHEN NOT long THEN n END, CASE WHEN long THEN 0 ELSE n END, CASE WHEN long THEN 0 ELSE n END FROM w""",
    "sentence_spans": f"""WITH {_found_sql('documents', _OWN)}
SELECT doc_id, para_idx, loc AS start, CAST(loc + length(s) AS INT) AS "end", md5(s) AS sentence_md5 FROM found_s""",
    "protected_spans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_SEED_TEXTS}[doc_id % {_N} + 1] AS t FROM documents),
k AS (SELECT doc_id, unnest({_spans_sql('t', _PROTECTED)}) AS w FROM d)
SELECT doc_id, w.a AS start, w.b AS "end", CASE WHEN w.f[1] = '`' THEN 'inline' WHEN starts_with(w.f, 'http') THEN 'url' ELSE 'email' END AS kind, w.f AS found FROM k""",
    "match_texts": r"""WITH n AS (SELECT doc_id, translate(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g'), '‘’‚‛“”„‟', repeat(chr(39), 4) || repeat(chr(34), 4)) AS norm FROM documents)
SELECT doc_id, md5(norm) AS norm_md5, CAST(length(norm) AS INT) AS n_offsets FROM n""",
    "irregularities": rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*')) AS word FROM documents),
known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM ({_GOOD})),
u AS (SELECT doc_id, count(*) AS unknown FROM w WHERE NOT contains(word, '-') AND word NOT IN (SELECT word FROM known) GROUP BY doc_id),
j AS (SELECT doc_id, replace(word, '-', '') AS plain FROM w GROUP BY ALL HAVING count(DISTINCT contains(word, '-')) > 1), h AS (SELECT doc_id, count(*) AS hyphenation FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(unknown, 0) AS unknown, coalesce(hyphenation, 0) AS hyphenation,
  coalesce(regexp_matches(text, '\w+, \w+, and \w+') AND regexp_matches(text, '\w+, \w+ and \w+'), false) AS serial_comma FROM documents LEFT JOIN u USING (doc_id) LEFT JOIN h USING (doc_id)""",
    "visible_flags": f"""WITH {_found_sql('documents', _OWN)} SELECT type, dim, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found WHERE dim <> 'd2' GROUP BY type, dim""",
}

# Flags in sentences and sections: the last sentence that begins at or before them.
_PLACES = f"""{_found_sql('own', _OWN)}, sents AS (
  SELECT *, para_idx * 1000000000::BIGINT + loc AS pos, CAST(row_number() OVER o - 1 AS INT) AS sentence, regexp_matches(s, '^#{{1,6}}\\s') AS head,
    sum(CAST(regexp_matches(s, '^#{{1,6}}\\s') AS INT)) OVER o AS by_head, sum(CAST(regexp_matches(s, '^#{{1,6}}\\s') AS INT)) OVER (PARTITION BY doc_id) AS heads, sum(n) OVER o - n AS before
  FROM found_n WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx, loc ROWS UNBOUNDED PRECEDING)),
secs AS (SELECT *, CAST(CASE WHEN heads > 0 THEN by_head ELSE floor(before / 400) END AS INT) AS section FROM sents),
met AS (SELECT f.*, p.sentence, p.section, p.para_idx = f.para_idx AND f."end" <= p.loc + length(p.s) AS inside
  FROM (SELECT *, para_idx * 1000000000::BIGINT + start AS pos FROM found WHERE start IS NOT NULL) f ASOF LEFT JOIN secs p ON f.doc_id = p.doc_id AND f.pos >= p.pos)"""
_SEVERITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITIES.items()) + " END"

ORACLE_SQL |= {
    "phrase_hits": r"""WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
runs AS (SELECT DISTINCT lower(array_to_string(r, ' ')) AS phrase FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS r FROM w) WHERE len(list_filter(r, lambda x: NOT regexp_full_match(x, '[A-Za-z]+'))) = 0),
lexicon AS (SELECT phrase, string_split(phrase, ' ')[1] AS a, string_split(phrase, ' ')[2] AS b, string_split(phrase, ' ')[3] AS c FROM runs),
pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS p FROM documents)),
placed AS (SELECT *, CAST(sum(length(p)) OVER o - length(p) AS INT) AS loc, lead(p, 1) OVER o AS g1, lead(p, 2) OVER o AS b, lead(p, 3) OVER o AS g2, lead(p, 4) OVER o AS c
  FROM pieces WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, phrase, loc AS start, CAST(loc + length(phrase) AS INT) AS "end" FROM placed p JOIN lexicon l ON p.p = l.a AND p.b = l.b AND p.c = l.c WHERE g1 = ' ' AND g2 = ' ' AND l.a <> l.b AND l.a <> l.c""",
    "flags_in_sentences": f"""WITH own AS (SELECT * FROM documents), {_PLACES}
SELECT doc_id, para_idx, start, "end", type, found, sentence, coalesce(inside, false) AS inside FROM met""",
    "section_scores": f"""WITH own AS (SELECT * FROM documents WHERE len({words_sql("coalesce(text, '')")}) > 1200), {_PLACES},
per AS (SELECT doc_id, section, CAST(sum(n) AS BIGINT) AS n_words, count(*) AS n_sentences, 4.0::DOUBLE {" ".join(f"- max(CAST(regexp_matches(s, '{p}') AS INT))" for p in _SIGNS)} AS d5 FROM secs GROUP BY doc_id, section),
counted AS (SELECT doc_id, section, count(*) AS n_flags, {", ".join(f"count(*) FILTER (dim = '{d}') AS n_{d}" for d in ("d1", "d2", "d3", "d4"))} FROM met GROUP BY doc_id, section),
dims AS (SELECT doc_id, section, n_words, n_sentences, coalesce(n_flags, 0) AS n_flags, {", ".join(f"{_density_sql(f'coalesce(n_{d}, 0)')} AS {d}" for d in ("d1", "d2", "d3", "d4"))}, d5 FROM per LEFT JOIN counted USING (doc_id, section)),
scored AS (SELECT *, floor((d1 + d2 + d3 + d4 + d5) * 10 + 0.5::DOUBLE) / 10 AS total FROM dims), mean AS (SELECT *, avg(total) OVER (PARTITION BY doc_id) AS m FROM scored)
SELECT * EXCLUDE (m), round(m, 6) AS doc_mean, abs(total - m) > 4 AS deviates FROM mean""",
    "highlights": f"""WITH {_found_sql('documents', _OWN)},
rows AS (SELECT doc_id, para_idx, concat_ws('|', para_idx, type, found, start) AS id, start AS a, "end" AS b, {_SEVERITY} AS severity FROM found WHERE start IS NOT NULL),
kept AS (SELECT doc_id, para_idx, unnest(list_reduce(list([{{'a': a, 'b': b, 'id': id, 'severity': severity}}] ORDER BY severity DESC, b - a DESC, a, b, id),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a < x[1].b AND x[1].a < y.b)) = 0 THEN acc || x ELSE acc END)) AS k FROM rows GROUP BY doc_id, para_idx),
used AS (SELECT doc_id, para_idx, k.id, k.a AS start, k.b AS "end", k.severity, sum(k.b - k.a) OVER (PARTITION BY doc_id ORDER BY k.severity DESC, k.a, k.id ROWS UNBOUNDED PRECEDING) AS used FROM kept)
SELECT doc_id, para_idx, id, start, "end", severity, used <= 0.2::DOUBLE * length(coalesce(text, '')) AS shown FROM used JOIN documents USING (doc_id)""",
}

ORACLE_SQL |= {
    "mined_phrases": """WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM good) AS good, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)*') AS w FROM documents),
n AS (SELECT count(*) FILTER (NOT good) AS studied, count(*) FILTER (good) AS good FROM d),
s AS (SELECT DISTINCT doc_id, good, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM d),
c AS (SELECT phrase, count(*) FILTER (NOT s.good) AS docs, count(*) FILTER (s.good) AS good_docs FROM s GROUP BY phrase),
r AS (SELECT *, docs / studied AS rate, good_docs / greatest(1, good) AS good_rate FROM c, n)
SELECT phrase, docs, round(rate, 6) AS rate, good_docs, round(good_rate, 6) AS good_rate FROM r WHERE docs >= greatest(2, 0.01::DOUBLE * studied) AND rate >= 2 * good_rate""",
    "sketch_thresholds": f"""WITH {readability_sql('documents')}
SELECT CAST(quality AS VARCHAR) AS class, count(*) AS docs, unnest([0.05::DOUBLE, 0.5, 0.95]) AS share, true AS within FROM r JOIN labels USING (doc_id) GROUP BY quality""",
}

_EDITED = f"""d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))} AS ts FROM documents),
edited AS (SELECT doc_id, array_to_string(list_transform(ts, lambda t, i: CASE WHEN i = 1 AND doc_id % 4 = 1 AND contains(t, ' of ') THEN left(t, strpos(t, ' of ') - 1) || ' by ' || substr(t, strpos(t, ' of ') + 4) ELSE t END), chr(10)) AS text FROM d WHERE len(ts) > 0)"""
_SPLIT_ENDS = "(VALUES " + ", ".join(f"({i}, '{kind}', {tier}, {start}, {_quoted(text[:start])}, {_quoted(text)})" for i, (text, split) in enumerate(SPLIT_SEEDS) if split for kind, tier, start in (split,)) + ") AS k(seed, kind, tier, start, l, t)"

ORACLE_SQL |= {
    "incremental_scores": f"""WITH {_EDITED}, {_scores_sql('edited', _OWN)},
left_over AS (SELECT doc_id, {", ".join(f"count(*) FILTER (dim = '{d}') AS n_{d}" for d in ("d1", "d2", "d3", "d4"))} FROM scored_found WHERE start IS NOT NULL AND NOT (type = 'Semicolon' AND doc_id % 4 = 2) GROUP BY doc_id),
dims AS (SELECT doc_id, n_words, {", ".join(f"{_density_sql(f'coalesce(n_{d}, 0)')} AS {d}" for d in ("d1", "d2", "d3", "d4"))}, d5 FROM (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, d5 FROM scored_t) LEFT JOIN left_over USING (doc_id)),
summed AS (SELECT *, floor((d1 + d2 + d3 + d4 + d5) * 10 + 0.5::DOUBLE) / 10 AS total FROM dims)
SELECT *, CASE WHEN total >= 15 THEN 'heavy' WHEN total >= 10 THEN 'moderate' WHEN total >= 6 THEN 'light' WHEN total > 0 THEN 'low' ELSE 'none' END AS verdict FROM summed""",
    "rewrite_stream": f"SELECT doc_id, output_md5, n_changes FROM ({ORACLE_SQL['rewrite_outputs']})",
    "partitioned_results": f"""WITH {readability_sql("(SELECT * FROM documents WHERE source IS NOT NULL)")}
SELECT source, count(*) AS docs, round(avg(score + CASE WHEN source = (SELECT min(source) FROM documents) THEN 1 ELSE 0 END), 4) AS avg_score, min(doc_id) AS first_doc FROM r GROUP BY source""",
    "sql_flags": f"""WITH {_found_sql('documents', _OWN)}
SELECT doc_id, para_idx, type, dim, count(*) AS n, min(start) AS first, max("end") AS last FROM found WHERE start IS NOT NULL GROUP BY ALL""",
    "split_seeds": f"""SELECT doc_id, kind, CAST(tier AS INT) AS tier, CAST(start AS INT) AS start, l AS left,
  substr(t, start + 1 + length(regexp_extract(substr(t, start + 1), '^(?:;|, and|,) '))) AS right FROM documents JOIN {_SPLIT_ENDS} ON doc_id % {len(SPLIT_SEEDS)} = seed""",
}

_BY_SOURCE = ORACLE_SQL["style_distance"].replace("lang", "source")
ORACLE_SQL |= {
    "nearest_authors": f"""WITH near AS ({_BY_SOURCE}), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY delta, author_id) AS INT) AS rank FROM near)
SELECT doc_id, author_id, delta, rank FROM ranked WHERE rank <= 3""",
    "whole_diffs": ORACLE_SQL["paragraph_diffs"].replace("CASE WHEN NOT long THEN n END, CASE WHEN long THEN 0 ELSE n END, CASE WHEN long THEN 0 ELSE n END", "n, n, n"),
}


def _rules_sql(seed: str) -> str:
    """The rewrite of a sentence of ``rule_seeds`` as nested replacements, rule by rule."""
    rules = default_rules()
    literal = lambda p: re.sub(r"([^A-Za-z0-9_ '])", r"\\\1", p).replace("'", "[''’]")
    out = seed
    for phrase in rules.deletes["sentenceStartDeletes"]:
        out = f"regexp_replace({out}, '^{literal(phrase)} they', 'They')"
    for phrase in rules.deletes["midSentenceDeletes"]:
        out = f"regexp_replace({out}, '(?i)\\b{literal(phrase)}\\b', '', 'g')"
    out = f"regexp_replace({out}, ' {{2,}}', ' ', 'g')"
    for swaps in rules.swaps.values():
        for find, to, _ in sorted(swaps, key=lambda r: -len(r[0])):
            out = f"regexp_replace({out}, '(?i)\\b{literal(find)}\\b', {_quoted(to)}, 'g')"
    return f"regexp_replace({out}, ' {{2,}}', ' ', 'g')"


_SEEDED_RULES = "[" + ", ".join(map(_quoted, rule_seeds())) + f"][doc_id % {len(rule_seeds())} + 1]"

ORACLE_SQL |= {
    "rewrite_rules": f"""WITH s AS (SELECT doc_id, {_SEEDED_RULES} AS seed FROM documents), o AS (SELECT DISTINCT seed, {_rules_sql('seed')} AS output FROM (SELECT DISTINCT seed FROM s))
SELECT doc_id, seed, output, seed <> output AS changed FROM s JOIN o USING (seed)""",
    "joined_paragraphs": f"""WITH d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))} AS ts FROM documents)
SELECT doc_id, md5(array_to_string(ts, chr(10))) AS output_md5 FROM d WHERE len(ts) > 0""",
    "class_separation": f"""WITH {readability_sql('documents')}, c AS (SELECT CAST(quality AS VARCHAR) AS class, avg(score) AS mean, stddev_pop(score) AS dev, min(score) AS least, max(score) AS greatest FROM r JOIN labels USING (doc_id) GROUP BY quality)
SELECT a.class AS class_a, b.class AS class_b, round((a.mean - b.mean) / sqrt((a.dev * a.dev + b.dev * b.dev) / 2), 6) AS separation, a.least <= b.greatest AND b.least <= a.greatest AS overlap FROM c a JOIN c b ON a.class < b.class""",
    "projected_scores": f"""WITH {_found_sql('documents', _OWN)}, f AS (SELECT doc_id, dim, type = 'Word choice' AND start % 2 = 0 AS done FROM found WHERE start IS NOT NULL),
d AS (SELECT doc_id, {", ".join(f"CASE WHEN count(*) FILTER (dim = '{k}') > 0 THEN floor(count(*) FILTER (dim = '{k}' AND NOT done) / count(*) FILTER (dim = '{k}') * 8 + 0.5::DOUBLE) / 2 ELSE 0 END AS {k}" for k in ("d1", "d2", "d3", "d4"))} FROM f GROUP BY doc_id)
SELECT *, d1 + d2 + d3 + d4 + 4 AS total, CASE WHEN d1 + d2 + d3 + d4 + 4 >= 15 THEN 'heavy' WHEN d1 + d2 + d3 + d4 + 4 >= 10 THEN 'moderate' WHEN d1 + d2 + d3 + d4 + 4 >= 6 THEN 'light' ELSE 'low' END AS verdict FROM d""",
    "invalid_scores": f"""WITH {_scores_sql('documents', _OWN)}
SELECT doc_id, total + CASE WHEN doc_id % 14 = 0 THEN 21 ELSE 0 END AS total, CASE WHEN doc_id % 14 = 7 THEN 'human' ELSE verdict END AS verdict,
  CASE WHEN doc_id % 14 = 0 THEN 'total out of range' ELSE 'unknown verdict' END AS failure FROM scored WHERE doc_id % 7 = 0""",
    "reverted_edits": f"""WITH d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))}[1] AS t FROM documents), p AS (SELECT * FROM d WHERE t IS NOT NULL),
e AS (SELECT *, CASE WHEN doc_id % 2 = 1 AND contains(t, 'e') THEN left(t, strpos(t, 'e') - 1) || 'E1' || substr(t, strpos(t, 'e') + 1) ELSE t END AS u FROM p)
SELECT doc_id, md5(CASE WHEN contains(u, 'a') THEN left(u, strpos(u, 'a') - 1) || 'A2' || substr(u, strpos(u, 'a') + 1) ELSE u END) AS output_md5, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END AS n_edits,
  CAST(doc_id % 2 = 1 AND NOT contains(t, 'e') AS INT) + CAST(NOT contains(u, 'a') AS INT) AS n_missing FROM e""",
}

#: What a switch that is off leaves of the seeds: seed, text.
_STAYS = {
    "contractions": {2: "They don't use it.", 9: "WE DON'T USE IT."},
    "emojis": {5: "They cheer 🎉 and will use the wind, and they should use it."},
    "dashes": {3: "Pages 3–5 count — all of them."},
}
_TOGGLED = {k: "[" + ", ".join(_quoted(own.get(i, out)) for i, (_, out, _) in enumerate(SEEDS)) + f"][doc_id % {_N} + 1] AS {k}_stay" for k, own in _STAYS.items()}

ORACLE_SQL |= {
    "rewrite_toggles": f"SELECT doc_id, {', '.join(_TOGGLED.values())} FROM documents",
    "second_rewrite": "SELECT doc_id, 0 AS n_changes FROM documents",
    "heading_flags": r"""WITH t AS (SELECT doc_id, '# Same one' || chr(10) || '## same two' || chr(10) || '# ' || CASE WHEN doc_id % 2 = 1 THEN 'Same' ELSE 'Other' END || ' three' || chr(10)
  || '# ' || coalesce(string_split(lower(text), ' ')[1], '') || ' x' || chr(10) || coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, lower(regexp_extract(regexp_replace(unnest(regexp_extract_all(t, '(?m)^#{1,6}\s+.*$')), '^#+\s+', ''), '[A-Za-z0-9''’-]+')) AS w FROM t)
SELECT doc_id, w AS found, count(*) || ' headings start with "' || w || '"' AS excerpt FROM l WHERE w <> '' GROUP BY doc_id, w HAVING count(*) >= 3""",
    "manual_edits": f"""WITH d AS (SELECT doc_id, {_PARTS.replace('{n}', _NORMAL.replace('{t}', "coalesce(text, '')"))}[1] AS t FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN 'New' || chr(10) || 'text' WHEN contains(t, 'e') THEN left(t, strpos(t, 'e') - 1) || 'E1' || substr(t, strpos(t, 'e') + 1) ELSE t END) AS output_md5, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_edits
FROM d WHERE t IS NOT NULL""",
    "flag_options": f"""WITH {_found_sql('documents', {'of': 'd1'})}, a AS (SELECT unnest(['from', '']) AS a)
SELECT doc_id, para_idx, start, "end", CASE WHEN a = '' THEN 'delete it' ELSE a END AS label, CASE WHEN a = '' THEN '' WHEN left(found, 1) = 'O' THEN 'From' ELSE a END AS text FROM found, a WHERE type = 'Word choice'""",
}
