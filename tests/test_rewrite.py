import pandas as pd
import pytest
from pyspark.sql import functions as F

from prose_audit.functions import batches
from prose_audit.functions import text as X
from prose_audit.operators import rewrite as R
from prose_audit.sources import rules as S

RULES = S.default_rules(["Acme", "Acme Plus"])
OWN = R.Rewriter(RULES)


def out(text):
    return OWN.rewrite(text)[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("10,000–50,000", "10,000 to 50,000"),
        ("In today's fast-paced business environment, organizations must leverage cutting-edge solutions in order to stay ahead", "Organizations must use modern solutions to stay ahead"),
        ("A Deep Dive into X", "A Close look at X"),
        ("engineering — and, at the end of the day, it's simply", "engineering, and, it is simply"),
        ("journey with us! 🎉 Visit", "journey with us! Visit"),
        ("Utilize", "Use"), ("UTILIZE", "USE"), ("utilize", "use"), ("I'M", "I AM"), ("I’m", "I am"),
        ("1–2–3", "1 to 2, 3"), ("x --flag", "x, flag"),
        ("write a.utilize@x.com or https://x.com/utilize now", "write a.utilize@x.com or https://x.com/utilize now"),
        ("run `utilize` and ```\nutilize — x\n```", "run `utilize` and ```\nutilize — x\n```"),
        ("Acme Plus utilize—Acme", "Acme Plus use, Acme"),
        ("The eval harness regression-tests every change.", None), ("A test harness runs the suite nightly.", None),
        ("We had no leverage in that negotiation.", None), ("Financial leverage increased the risk.", None),
        ("Leverage increased the risk last year.", None), ("Our robust harness handles retries.", "Our strong harness handles retries."),
        ("The team will leverage the new API.", "The team will use the new API."), ("You should harness the wind for power.", "You should use the wind for power."),
        ("Harness the wind for power.", "Use the wind for power."), ("Companies leverage data to make decisions.", "Companies use data to make decisions."),
        ("Server utilization hit ninety percent.", "Server use hit ninety percent."),
        ("It is worth noting that the sky is blue. Basically, yes.", "The sky is blue. Yes."),
        ("réutilize naïveutilize utilized_x", "réuse naïveutilize utilized_x"),
        ("", ""), ("a  b \nc", "a b\nc"),
    ],
)
def test_passes(text, want):
    assert out(text) == (text if want is None else want)


def test_log():
    new, log = OWN.rewrite("We utilize tools, needless to say, in order to win 🎉🎉.")
    assert new == "We use tools, to win."
    assert [c[:3] for c in log] == [("Emoji removal", "2 emoji(s)", "(removed)"), ("Removed filler", ", needless to say,", "(removed)"), ("Filler phrase", "in order to", "to"), ("Simpler word", "utilize", "use")]
    assert log[2][3] == "We utilize tools, in order to win."


def test_documents(spark):
    rows = [(1, "We utilize it.\n\nA seamless plan — in order to win."), (2, None), (3, "  \r\n\r\n "), (4, "plain"), (4, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = R.rewrite_documents(df, RULES)
    got = sorted(done.select("doc_id", R.output_text().alias("o"), R.change_count().alias("n")).collect())
    assert [tuple(r) for r in got] == [(1, "We use it.\n\nA smooth plan, to win.", 4), (2, "", 0), (3, "", 0), (4, "plain", 0), (4, "plain", 0)]
    assert R.change_rows(done).count() == 4
    back = R.join_paragraphs(R.paragraph_rows(done).filter("doc_id = 1")).first()
    assert back.output == got[0].o
    whole = R.rewrite_documents(df, RULES, grain="document").select(R.output_text().alias("o")).first()
    assert whole.o == "We use it.\n\nA smooth plan, to win."
    stats = R.document_stats(done).filter("doc_id = 1").first()
    assert stats.change_count == 4 and stats.words_saved == 2
    usage = {(r.list, r.find): (r.hits, r.docs) for r in R.rule_usage(done, S.rule_table(spark, RULES)).collect()}
    assert usage["simpleSwaps", "utilize"] == (1, 1) and usage["fillerPhrases", "in order to"] == (1, 1) and usage["hypeSwaps", "robust"] == (0, 0)
    assert R.rewrite_documents(df.limit(0), RULES).count() == 0


def test_idempotent_and_clean_text_untouched():
    text = "The plan is simple. Nobody minds, and it works."
    assert out(text) == text


def brute_syllables(word):
    import re

    word = re.sub("[^a-z]", "", word.lower())
    if not word:
        return 0
    if len(word) <= 3:
        return 1
    word = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", word))
    return len(re.findall("[aeiouy]{1,2}", word)) or 1


def test_syllables_and_flesch(spark):
    words = ["the", "make", "table", "played", "utilize", "beautiful", "10", "yxes", "y", "yyyy", "rhythms", "o'clock", "seed", "été", "aeiou", "bdfe", "eyes", "-", "yes-no"]
    df = spark.createDataFrame([(w,) for w in words] + [(" ".join(words),)], "w string")
    got = [r[0] for r in df.select(X.syllable_count(F.col("w"))).collect()]
    import re

    for w, n in zip([*words, " ".join(words)], got):
        assert n == sum(brute_syllables(x) for x in re.findall("[A-Za-z0-9'’-]+", w)), w
    assert got[:7] == [1, 1, 2, 1, 3, 4, 0]
    texts = ["The cat sat.", "See Dr. Smith. It costs 3.5 units, e.g. today.", "We sell pens, ink, etc. Come by.", "", None, "# Head\nText here. Next one."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.flesch(F.coalesce("t", F.lit(""))).alias("f")).collect()
    assert tuple(rows[0].f) == (119.2, -2.6, 3, 1, 3.0)
    assert [r.f.sentences for r in rows] == [1, 2, 1, 0, 0, 2] and tuple(rows[3].f) == (0, 0, 0, 0, 0) and rows[5].f.words == 5


def test_rules(spark):
    table = S.rule_table(spark, RULES)
    assert {r.list: r["count"] for r in table.groupBy("list").count().collect()} == {
        "simpleSwaps": 75, "hypeSwaps": 34, "fillerPhrases": 38, "contractions": 33, "sentenceStartDeletes": 14, "midSentenceDeletes": 6, "flagWords": 31, "protectedTerms": 2,
    }
    assert S.load_style_config(S.export_config(RULES)) == RULES
    with pytest.raises(ValueError):
        S.load_style_config("{}")
    assert S.load_style_config('{"settings": {}, "simpleSwaps": []}').settings == {"maxSentenceWords": 28, "maxParagraphSentences": 6, "splitMaxTier": 2, "minClauseWords": 4}
    lines = spark.createDataFrame([("a => b",), (" c=>d | verbOnly ",), ("no arrow",), ("a => b => c",), (" => x",), ("gone =>",)], "value string")
    assert sorted(map(tuple, S.parse_swap_lines(lines).collect())) == [("a", "b", False), ("c", "d", True), ("gone", "", False)]
    flags = spark.createDataFrame([("w",), ("w | r | s | d1 | a; b;",), ("|x",), ("w | | s",)], "value string")
    got = S.parse_flag_lines(flags).collect()
    assert [tuple(r) for r in got] == [("w", "Blocked word", "Rewrite this", None, None), ("w", "r", "s", "d1", ["a", "b", ""]), ("w", "Blocked word", "s", None, None)]
    assert [tuple(r) for r in got] == [S.flag_line(x) for x in ("w", "w | r | s | d1 | a; b;", "w | | s")]
    back = {r.list: r.lines for r in S.swap_lines(table).collect()}
    assert [S.swap_line(x) for x in back["hypeSwaps"].split("\n")] == RULES.swaps["hypeSwaps"]
    other = S.default_rules()
    other.swaps["hypeSwaps"] = [("robust", "sturdy", False), ("brand-new", "new", False)] + [r for r in other.swaps["hypeSwaps"] if r[0] not in ("robust", "delve")]
    diff = {(r.list, r.find): r.status for r in S.compare_rules(table, S.rule_table(spark, other)).collect()}
    assert diff == {("hypeSwaps", "robust"): "changed", ("hypeSwaps", "brand-new"): "added", ("hypeSwaps", "delve"): "removed", ("protectedTerms", "Acme"): "removed", ("protectedTerms", "Acme Plus"): "removed"}


def test_batches_are_rewritten_in_pieces(monkeypatch):
    """A batch of Spark comes back in pieces of few characters, whole and in order."""
    monkeypatch.setattr(batches, "CHARS", 100)
    rows = [[f"We utilize {i}.", "We leverage it."] for i in range(40)] + [None, [], ["x" * 500]]
    out = list(R.rewritten_batches(iter([pd.Series(rows)]), RULES))
    assert len(out) > 10 and max(sum(len(p["original"]) for row in part for p in row) for part in out[:-1]) <= 100
    flat = [row for part in out for row in part]
    assert [[p["original"] for p in row] for row in flat] == [row or [] for row in rows]
    assert flat[7][0]["output"] == "We use 7." and flat[7][0]["changes"][0]["category"] == "Simpler word"
