import random
import re

import pytest
from pyspark.sql import functions as F

from prose_audit.functions.patterns import BLANKS
from prose_audit.operators import flags as FL
from prose_audit.operators import rewrite as R
from prose_audit.operators import scoring as SC
from prose_audit.operators import spans as SP
from prose_audit.sources import rules as S

RULES = S.default_rules(["Acme Platform"])
LONG = "This sentence goes on and on with more words than anybody would like to read in one go because it never seems to come to any end at all today."


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def found(spark, text):
    out = FL.flag_documents(rows(spark, [text]), RULES).first().flags
    return [(f.type, f.found) for f in out]


def test_each_flag(spark):
    texts = [
        "A landscape of game-changing tools.", LONG, "The plan was written. It was based on facts. It was based on facts by us.", "One; two.",
        "A b. C d. E f. G h. I j. K l. M n.", "The cat ran. The cat sat. The cat ate.", "Also, a. However, b. So c.", "# Why one\n\n# Why two\n\n## Why three",
        "# Heading; was written", None, "", "`landscape; was written` and https://landscape.com/;x.", "Acme Platform landscape; Acme Platform",
    ]
    got = [[(f.type, f.found) for f in r.flags] for r in FL.flag_documents(rows(spark, texts), RULES).orderBy("doc_id").collect()]
    assert got[0] == [("Word choice", "game-changing"), ("Word choice", "landscape")]
    assert got[1] == [("Long sentence", "30 words")]
    assert got[2] == [("Passive voice", "was written")]
    assert got[3] == [("Semicolon", ";")]
    assert got[4] == [("Long paragraph", "7 sentences")]
    assert got[5] == [("Repetitive rhythm", '3 sentences start with "the cat"')]
    assert got[6] == [("Repetitive rhythm", "3 occurrences")]
    assert got[7] == [("Repetitive headings", "why")]
    assert got[8] == got[9] == got[10] == got[11] == []
    assert got[12] == [("Word choice", "landscape"), ("Semicolon", ";")]
    last = FL.flag_documents(rows(spark, texts), RULES).filter("doc_id = 12").first().flags
    assert last[1].excerpt == "Acme Platform landscape; Acme Platform"
    assert FL.flag_documents(rows(spark, texts).limit(0), RULES).count() == 0


def test_passive_rule(spark):
    df = rows(spark, ["It was based on facts.", "It was based by us.", "It is written by us.", "They are open.", "It was down.", "No verb."])
    assert [r[0] for r in df.select(FL.passive_match(F.col("text"))).collect()] == ["", "was based by", "is written by", "are open", "was down", ""]


def test_offsets_and_claims(spark):
    text = f"The landscape was written by us; studies show up to 40% more in the realm of it. {LONG} `landscape` x"
    out = FL.Reviewer(RULES).review(text)
    for a, b, kind, dim, what, *_, how, by, excerpt in out:
        if how != "advice-span":
            assert text[a:b] == what
    spans = [(a, b) for a, b, *_, how, by, e in out if how != "advice-span"]
    assert all(not (a < d and c < b) for i, (a, b) in enumerate(spans) for c, d in spans[:i])
    kinds = {f[2] for f in out}
    assert kinds == {"Word choice", "Passive voice", "Semicolon", "Missing specifics", "Long sentence"}
    paragraphs = spark.createDataFrame([(1, 0, text), (1, 1, None)], "doc_id long, para_idx int, output string")
    docs = rows(spark, ["", "Also, a. However, b. So c."])
    got = FL.review_flags(paragraphs, RULES, documents=docs)
    assert got.filter("para_idx is null").count() == 1 and got.filter("para_idx = 0").count() == len(out)


def test_sentence_spans(spark):
    rng = random.Random(2)
    texts = ["", "One. Two!  Three? e.g. this. Dr. Who", " a\xa0. b. ", "".join(rng.choice("ab .!?\n1") for _ in range(300))]
    from prose_audit.functions import text as X

    df = rows(spark, texts)
    for r in df.select("text", SP.sentence_spans(F.col("text")).alias("s"), X.sentences(F.col("text")).alias("x")).collect():
        assert [r.text[s.start : s.end] for s in r.s] == [s.text for s in r.s] == r.x


def test_protected(spark):
    df = rows(spark, ["see `x;y` or https://a.b/c;d and me@x.com Acme Platform."])
    r = df.select("text", SP.protected_ranges(F.col("text"), ["Acme Platform"]).alias("p")).first()
    assert [(r.text[s.start : s.end], s.kind) for s in r.p] == [("`x;y`", "inline"), ("https://a.b/c;d", "url"), ("me@x.com", "email"), ("Acme Platform", "term")]
    r = df.select(SP.free_of(SP.protected_ranges(F.col("text")), F.lit(5), F.lit(6)), SP.sentence_range(SP.sentence_spans(F.col("text")), F.lit(1), F.lit(3))["text"]).first()
    assert r[0] is False and r[1].startswith("see")
    assert [x[2] for x in SP.find_unsplittable('a "b; c" (d [e]) {f', [])] == ["quote", "bracket", "bracket"]


@pytest.mark.parametrize("flags, words, want", [(3, 500, 2.5), (9, 1000, 4.0), (20, 1000, 4.0), (0, 100, 0.0), (1, 0, 0.0), (1, 1000, 0.5)])
def test_density(spark, flags, words, want):
    assert spark.range(1).select(SC.density_score(F.lit(flags), F.lit(words))).first()[0] == want


def test_totals(spark):
    df = spark.createDataFrame([(2.5, 1.0, 0.0, 4.0, 3.0)], "d1 double, d2 double, d3 double, d4 double, d5 double")
    t = df.select(SC.total([F.col(f"d{i}") for i in range(1, 6)], [1.0] * 5).alias("t")).first().t
    assert t == 10.5
    for score, want in [(15.0, "heavy"), (14.9, "moderate"), (10.0, "moderate"), (6.0, "light"), (0.1, "low"), (0.0, "none")]:
        assert df.select(SC.verdict(F.lit(score))).first()[0] == want
    for score, want in [(4.0, "human-written"), (8.5, "mild"), (13.5, "substantial"), (13.6, "heavy")]:
        assert df.select(SC.band(F.lit(score))).first()[0] == want
    docs = rows(spark, ["word " * 500, "I was here on 3.5 May 2020. I think Ann Lee agrees, too.", None])
    flags = spark.createDataFrame([(0, "d1")] * 3 + [(0, "d2")], "doc_id long, dim string")
    got = {r.doc_id: r for r in SC.weighted_band(SC.score_documents(docs, flags)).collect()}
    assert (got[0].d1, got[0].d2, got[0].d5, got[0].total) == (2.5, 1.0, 4.0, 7.5) and got[0].verdict == "light"
    assert got[1].d5 == 0 and got[1].missing == [] and got[2].n_words == 0
    assert SC.validate_scores(SC.score_documents(docs, flags)).count() == 0


def test_findings(spark):
    f = spark.createDataFrame([(1, "a", 0, 10, 1), (1, "b", 5, 8, 3), (1, "c", 12, 20, 2), (1, "d", 12, 15, 2), (2, "e", 0, 1, 1)], "doc_id long, id string, start int, end int, severity int")
    assert sorted(r.id for r in SC.resolve_findings(f).collect()) == ["b", "c", "e"]
    capped = SC.cap_highlights(f, spark.createDataFrame([(1, 40), (2, 3)], "doc_id long, n_chars long"))
    assert {r.id: r.shown for r in capped.collect()} == {"b": True, "c": False, "d": False, "a": False, "e": False}
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 12.0), (1, 2, 2.0)], "doc_id long, section int, score double")
    assert [r.deviates for r in SC.section_scores(s).orderBy("section").collect()] == [False, True, False]
    flags = spark.createDataFrame([(1, 0, "t", "x", i, "d1") for i in range(4)], "doc_id long, para_idx int, type string, found string, start int, dim string")
    done = flags.filter("start < 2")
    assert SC.projected_score(flags, done).first().d1 == 2.0 and SC.open_flags(flags, done).count() == 2
    g = spark.createDataFrame([(100, 0.1, 3, 0.9), (2000, 0.5, 1, 0.0)], "n_words int, section_len_cv double, sections int, marketing_share double")
    assert [[x.id for x in r.guards] for r in SC.guards(g).orderBy("n_words").collect()] == [["G-5", "G-3", "G-6"], []]
    c = g.select(SC.confidence(F.col("n_words"), F.lit(0), F.lit(4), F.lit(False)).alias("c"), "n_words").orderBy("n_words").collect()
    assert [r.c for r in c] == ["low", "high"]


def test_golden(spark):
    import os

    text = open(os.path.join(os.path.dirname(__file__), "data", "article.md")).read()
    done = R.rewrite_documents(rows(spark, [text]), RULES)
    row = FL.flag_documents(done.withColumn("o", R.output_text()), RULES, text="o").first()
    assert {f.type for f in row.flags} >= {"Long sentence", "Passive voice", "Semicolon", "Word choice"}
    stats = R.document_stats(done).first()
    assert stats.change_count > 10 and stats.after.score >= stats.before.score
    for gone in ("—", "utilize", "in order to", "🚀", "cutting-edge"):
        assert gone not in row.o.replace("https://example.com/utilize", "").replace("`utilize`", "")
    assert "https://example.com/utilize" in row.o and "`utilize`" in row.o and "Acme Platform" in row.o


def test_unchanged_paragraphs_are_looked_at_once(spark):
    """Scores of both sides are those of each side alone; a paragraph that stays as it is is reviewed once."""
    texts = ["We utilize it; it was seen.\n\nMany people say up to 5% of it is used by them.\n\nI think so.", None, "", "Plain.\n\nPlain.", "January 5; we leverage 3.5 of it.\n\nMr. Smith saw 20 percent."]
    done = R.rewrite_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RULES)
    both = {r.doc_id: r for r in SC.score_before_after(done, RULES).collect()}
    for side, name in (("before", "original"), ("after", "output")):
        alone = done.select("doc_id", SC.score_in_row(R.output_text("\n\n", name), F.col(f"paragraphs.{name}"), RULES).alias("s")).collect()
        assert {r.doc_id: r.s for r in alone} == {k: r[side] for k, r in both.items()}
    plan = SC.score_before_after(done, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the rewrite, and both sides at once


def test_signs_by_their_first_letters(spark):
    """Trying a sign only where it can begin finds what the pattern finds."""
    rng = random.Random(8)
    words = ["I", "we", "Our", "us", "mine", "bus", "2024", "19", "1999", "May 5", "June", "Monday", "3.5", "12", "5", "$5", "x3", "I think", "we hope", "Mr. X", "Dr. y", "Ann Lee", "a, Bo Li", "_I", "é", "."]
    texts = ["".join(x for _ in range(rng.randrange(4)) for x in (rng.choice(words), rng.choice([" ", ", ", "_", "\n", ". "]))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(*[F.col("t").rlike(SC.presence_pattern(k)) for k in SC.PRESENCE], SC.authorial_presence(F.col("t")).alias("p")).collect()
    for t, r in zip(texts, got):
        want = {k: re.search(p, t, re.A) is not None for k, p in SC.PRESENCE.items()}
        assert list(r[:4]) == list(want.values()), t
        assert r.p.signals == [k for k in want if want[k]] and r.p.missing == [k for k in want if not want[k]] and r.p.score == 4.0 - len(r.p.signals)


def test_reviewer_hints():
    """A specific claim or a passive that is looked for only after its hint is found all the same."""
    claims = ["Research SHOWS", "data indicates", "Critics Agree", "industry leaders say", "Up to 5.5%", "up to 7 percent", "Most Customers", "several teams", "It is Widely known", "9% here", "12 percent"]
    for claim in claims:
        assert any(f[2] == "Missing specifics" for f in FL.Reviewer(RULES).review(f"So {claim} of it.")), claim
    for verb in ("am", "IS", "are", "Was", "were", "been", "being", "be"):
        assert any(f[2] == "Passive voice" for f in FL.Reviewer(RULES).review(f"It {verb}\u00a0Written by us.")), verb
    for c in BLANKS:
        assert SP.find_sentences(f"{c}Dr. A saw 3.5.{c}{c}B!{c}") == [(1, 15, "Dr. A saw 3.5."), (17, 19, "B!")]
    assert [f[-1] for f in FL.Reviewer(RULES, excerpts=False).review("It is;")] == [None]


def test_dimensions_of_flags(spark):
    """Those of all flags, repeated doc_ids and documents' own flags included, and no more comes out of the helper."""
    texts = ["It is; it was seen by us.", "Also, a. However, b. So, c.", None, "# A b\n# A c\n# A d", "Many people say so."]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    paragraphs = docs.select("doc_id", F.lit(0).alias("para_idx"), F.col("text").alias("output"))
    own = FL.review_dimensions(paragraphs, RULES, documents=docs)
    want = FL.review_flags(paragraphs, RULES, documents=docs).select("doc_id", "dim")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect())) and own.count() == 5
    assert own.columns == ["doc_id", "dim"] and {t for _, t in FL.review_dimensions(paragraphs, RULES).dtypes} == {"bigint", "string"}


def test_flag_words_alone(spark):
    """They are those of all flags, and sentences aren't looked at."""
    docs = rows(spark, ["We leverage `x; y` a robust Acme Platform; it was seen.", None, "", "Utilize it. However, a seamless plan."])
    rules = S.default_rules(["Acme Platform"])
    rules.flags = [("robust", "Marketing hype", "Cut", None, None), ("plan", "Vague connective", "Cut", None, None)]
    words = FL.flag_words(docs, rules)
    want = FL.flag_documents(docs, rules).withColumn("flags", F.filter("flags", lambda f: f["type"] == FL.WORD_CHOICE))
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, want.collect()))
    assert sum(len(r.flags) for r in words.collect()) == 2
    assert "regexp" not in words._jdf.queryExecution().optimizedPlan().toString()
