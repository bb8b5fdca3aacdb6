import io
import random
import re
import statistics
import unicodedata
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prose_audit.functions import batches
from prose_audit.functions import text as X
from prose_audit.functions.patterns import WS
from prose_audit.operators import corpus as C
from prose_audit.operators import diff as D
from prose_audit.operators import metrics as M
from prose_audit.operators import review as RV
from prose_audit.operators import splits as SL
from prose_audit.operators import flags as FL
from prose_audit.operators import rewrite as R
from prose_audit.sources import documents as DOC
from prose_audit.sources import rules as S
from prose_audit.streaming.rewrite import rewrite_stream

RULES = S.default_rules()
SMALL = "/root/testdata/sf0.001"


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_diff(spark):
    assert D.difference("a b c", "a x c") == [("keep", "a "), ("del", "b"), ("add", "x"), ("keep", " c")]
    assert D.difference("a b c d", "a x y d") == [("keep", "a "), ("del", "b c"), ("add", "x y"), ("keep", " d")]
    assert D.difference("a  b", "a b") == [("keep", "a b")] and D.difference("", "") == []
    assert D.difference("x " * 500, "y")[0][0] == "skip"
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(["a", "b", "c", " ", "  "]) for _ in range(rng.randrange(14))) for _ in range(2))
        ops = D.difference(a, b)
        assert "".join(t for o, t in ops if o != "del") == b
    p = spark.createDataFrame([(1, 0, "a b", "a c"), (1, 1, "same", "same"), (1, 2, "x " * 900, "y")], "doc_id long, para_idx int, original string, output string")
    assert {r.para_idx: r.n_changes for r in D.diff_paragraphs(p).collect()} == {0: 1, 2: None}


SPLIT = [
    ("The engine applies swaps first; the audit runs afterwards.", "The engine applies swaps first. The audit runs afterwards."),
    ("The score dropped to eleven, but the long sentences were still flagged.", "The score dropped to eleven. But the long sentences were still flagged."),
    ("We shipped the module, and the tests passed on the first run.", "We shipped the module. The tests passed on the first run."),
    ("The corpus is missing, so every threshold stays provisional here.", "The corpus is missing. So every threshold stays provisional here."),
]
WHOLE = [
    "He ran the suite, and passed every check.", "Because the corpus is missing, thresholds are provisional.", "We shipped it, resulting in a faster review loop.",
    "The engine, which runs in Node, is portable.", "The loop `for (i = 0; i < n; i++)` runs in the test.", 'He said "the build is clean; the tests pass" in standup.',
    "It does three things: parse the input; score it; report.", "Use &amp; for an ampersand, and it renders fine.", "Open it, and go.", "The result was clear, and 3 of the tests failed.",
    "## Setup, and configuration; a guide", "We saw apples, pears, and the trees were green here.", "", None,
]


def test_splits(spark):
    df = rows(spark, [a for a, _ in SPLIT] + WHOLE)
    got = df.select("doc_id", "text", SL.split_candidates(F.col("text"), RULES).alias("c")).withColumn("out", SL.apply_splits(F.coalesce("text", F.lit("")), F.col("c"))).orderBy("doc_id").collect()
    for r in got:
        want = SPLIT[r.doc_id][1] if r.doc_id < len(SPLIT) else r.text or ""
        assert r.out == want, r
        for c in r.c:
            assert r.text[c.start : c.end] == c["from"] and c.preview == want
    again = rows(spark, [b for _, b in SPLIT]).select(F.size(SL.split_candidates(F.col("text"), RULES)).alias("n"))
    assert {r.n for r in again.collect()} == {0}
    off = S.default_rules()
    off.settings["splitMaxTier"] = 0
    assert {r[0] for r in df.select(F.size(SL.split_candidates(F.col("text"), off))).collect()} == {0}
    assert R.Rewriter(RULES).rewrite(SPLIT[0][0])[0] == R.Rewriter(off).rewrite(SPLIT[0][0])[0] == SPLIT[0][0]
    low = S.default_rules()
    low.settings["splitMaxTier"] = 3
    text = "Open the configuration tab, and press the Apply button to use the new rules."
    c = rows(spark, [text]).select(SL.split_candidates(F.col("text"), low).alias("c")).first().c
    assert [(x.kind, x.tier) for x in c] == [("SPLIT-C", 3)] and "lower confidence" in c[0].reason


def test_split_report_and_options(spark):
    long = "The team of the north office was running the whole suite of tests on the new machines over the weekend without any help, and the results were sent to everybody who asked for them on Monday."
    p = spark.createDataFrame([(1, 0, long), (1, 1, "word " * 40 + ".")], "doc_id long, para_idx int, output string")
    got = {r.para_idx: (r.tier, r.reason) for r in SL.split_report(p, RULES).collect()}
    assert got[0][0] == 2 and got[1] == (None, "no boundary to split at")
    own = S.default_rules()
    own.flags = [("landscape", "r", "s", "d1", ["market", ""])]
    q = spark.createDataFrame([(1, 0, "Landscape counts. " + SPLIT[0][0])], "doc_id long, para_idx int, output string")
    options = SL.suggest_options(FL.review_flags(q, own), q, own).collect()
    assert sorted((o.label, o.text, o.scope) for o in options) == sorted([("market", "Market", "phrase"), ("delete it", "", "phrase"), ("Compound sentence joined by a semicolon", SPLIT[0][1], "sentence")])


def test_review(spark):
    p = spark.createDataFrame([(1, 0, "a b a b"), (1, 1, "x. the big y, z"), (2, 0, "same")], "doc_id long, para_idx int, output string")
    e = spark.createDataFrame([(1, 0, 1, "b", "c", 1), (1, 0, 2, "a", "A", 0), (1, 0, 3, "q", "r", 0), (1, 1, 1, "the big", "", 0)], "doc_id long, para_idx int, seq int, `from` string, `to` string, nth int")
    got = {(r.doc_id, r.para_idx): (r.output, r.n_edits, r.missing) for r in RV.replay_edits(p, e).collect()}
    assert got == {(1, 0): ("A b a c", 3, [3]), (1, 1): ("x. Y, z", 1, []), (2, 0): ("same", 0, [])}
    none = RV.revert_edits(e, e)
    assert none.count() == 0 and {r.output for r in RV.replay_edits(p, none).collect()} == {r.output for r in p.collect()}
    manual = spark.createDataFrame([(1, 0, "new\n \nbase"), (2, 0, " ")], "doc_id long, para_idx int, text string")
    base, left = RV.manual_edits(p, e, manual)
    assert {(r.doc_id, r.para_idx): r.output for r in base.collect()} == {(1, 0): "new\nbase", (1, 1): "x. the big y, z", (2, 0): "same"} and left.count() == 1
    assert RV.touched_documents(p, e).select("doc_id").distinct().count() == 1
    f = spark.createDataFrame([(1, 0, "b", 2), (1, 0, "b", 6), (1, None, "b", None)], "doc_id long, para_idx int, found string, start int").withColumn("type", F.lit("t"))
    assert sorted(r.nth for r in RV.with_nth(f.filter("start is not null")).collect()) == [0, 1]
    assert [(r.position, r.n, r.start) for r in RV.work_list(f).orderBy("position").collect()] == [(1, 3, 2), (2, 3, 6), (3, 3, None)]


def test_metrics(spark):
    text = "One two three. A b c d e f g h i j. One two three!\n\nHowever, maybe it might work.\n\n- **Lead**: x\n- plain"
    r = M.document_metrics(rows(spark, [text, None])).orderBy("doc_id").collect()
    m = r[0]
    lengths = [len(re.findall("[A-Za-z][A-Za-z'-]*", s)) for s in ["One two three.", "A b c d e f g h i j.", "One two three!", "However, maybe it might work.", "- **Lead**: x\n- plain"]]
    assert m.sent_len_mean == pytest.approx(statistics.mean(lengths)) and m.sent_len_stdev == pytest.approx(statistics.pstdev(lengths))
    assert m.burstiness == pytest.approx(statistics.mean(abs(a - b) for a, b in zip(lengths, lengths[1:])) / statistics.mean(lengths))
    assert (m.sent_len_min, m.sent_len_max, m.shortest, m.sentences, m.paragraphs) == (3, 10, "One two three.", 5, 3)
    assert m.transition_open_rate == pytest.approx(1 / 3) and m.bold_lead_bullet_rate == 0.5 and m.hedge_density == pytest.approx(100 / sum(lengths))
    assert m.opener_repetition_rate == pytest.approx(2 / 5)
    assert r[1].words == 0 and r[1].sent_len_mean == 0 and r[1].burstiness == 0
    words = [random.Random(4).choice("abcdefgh") * 2 for _ in range(300)]
    want = statistics.mean(len(set(words[i : i + 100])) / 100 for i in range(201))
    assert rows(spark, [" ".join(words), "", "a b a"]).select(M.mattr(F.col("text")).alias("m")).collect()[0].m == pytest.approx(want)
    claims = rows(spark, ["Studies show it works for all of them and for us and for you and for nobody else. Research suggests, as Ann Lee wrote, more.", None]).select(M.authority_claims(F.col("text")).alias("n")).collect()
    assert [c.n for c in claims] == [1, 0]
    c = rows(spark, ["Planning matters always.\n\nOverall, planning matters always.", "a\n\nOverall, nothing repeated whatsoever"]).select(M.closing_restatement(X.paragraphs(F.col("text"))).alias("c")).collect()
    assert [x.c for x in c] == [True, False]
    long = "# A\n" + "one two three four. " * 400
    s = M.sections(rows(spark, [long, "one two three four. " * 400, "short."])).collect()
    assert sum(x.n_words for x in s if x.doc_id == 1) == 1600 and len([x for x in s if x.doc_id == 1]) == 4
    d = spark.createDataFrame([("one",), ("two",)], "word string")
    i = M.irregularities(rows(spark, ["one tow-two towtwo, a, b, and c; a, b and c", "One two", None]), d).orderBy("doc_id").collect()
    assert (i[0].unknown, i[0].hyphenation, i[0].serial_comma) == (5, 1, True) and (i[1].unknown, i[1].serial_comma, i[2].unknown) == (0, False, 0)


def test_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    profiles = C.language_profiles(docs)
    got = C.detect_language(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.95
    report = C.readability_report(docs, "lang").collect()
    assert sum(r.docs for r in report) == docs.count()
    scores = spark.createDataFrame([(i, float(i)) for i in range(10)], "doc_id long, total double")
    labels = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(10)], "doc_id long, class string")
    rates = C.class_rates(scores, labels, 3.0)
    assert {r["class"]: (r.docs, r.over) for r in rates.collect()} == {"a": (5, 0.4), "b": (5, 1.0)}
    sep = C.class_separation(rates).first()
    assert sep.separation == pytest.approx(-5 / statistics.pstdev(range(5))) and sep.overlap is False
    assert sorted(r.threshold for r in C.thresholds(scores, labels, [0.5]).collect()) == [2.0, 7.0]
    assert C.top_per_group(scores.join(labels, "doc_id"), "class", "total", "doc_id", 2).count() == 4


def test_style_distance(spark):
    texts = {0: "the cat and the dog", 1: "of a to of a to", 2: "the dog and a cat", 3: None}
    docs = rows(spark, list(texts.values()))
    base = spark.createDataFrame([("x", "the cat and the dog"), ("x", "the and the and"), ("y", "of a to")], "author_id string, text string")
    words = ["the", "and", "of", "a", "to"]
    got = {(r.doc_id, r.author_id): r.delta for r in C.style_distance(docs, base, words).collect()}

    def rate(t):
        w = (t or "").split()
        return [w.count(x) / len(w) if w else 0.0 for x in words]

    rates = [rate(t) for t in texts.values()]
    dev = [statistics.pstdev(c) for c in zip(*rates)]
    authors = {"x": [(a + b) / 2 for a, b in zip(rate("the cat and the dog"), rate("the and the and"))], "y": rate("of a to")}
    for (d, a), delta in got.items():
        assert delta == pytest.approx(statistics.mean(abs(r - m) / s for r, m, s in zip(rates[d], authors[a], dev)))
    assert len(got) == 8


def docx(paragraphs):
    out = io.BytesIO()
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}Heading{level}{chr(34)}/></w:pPr>" if level else ""}<w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>' for level, t in paragraphs)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/app.xml", "<Properties><TotalTime>7</TotalTime><Application>Word</Application></Properties>")
        z.writestr("docProps/core.xml", "<cp><dc:creator>Ann &amp; Lee</dc:creator></cp>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([(1, "Update"), (0, "Ampersand &amp; &lt;angle&gt;"), (0, " "), (5, "Deep")]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.md").write_text("# Head\n\ntext **bold** more\nline")
    (tmp_path / "d.doc").write_text("old")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    good, bad = DOC.route_files(files)
    assert good.count() == 3 and [r.reason[:7] for r in bad.collect()] == ["The old"]
    got = {r.path.rsplit("/", 1)[1]: r for r in DOC.read_docx(files.filter("path like '%.docx'")).collect()}
    assert got["a.docx"].text == "# Update\n\nAmpersand & <angle>\n\n### Deep" and got["bad.docx"].error
    about = {r.path.rsplit("/", 1)[1]: r for r in DOC.docx_provenance(files.filter("path like '%.docx'")).collect()}
    assert (about["a.docx"].total_time, about["a.docx"].creator, about["bad.docx"].creator) == ("7", "Ann & Lee", None)
    text = DOC.read_documents(spark, str(tmp_path / "c.md"))
    blocks = text.select(DOC.parse_blocks(F.col("text")).alias("b"))
    b = blocks.first().b
    assert [(x.level, [(r.text, r.bold) for r in x.runs]) for x in b] == [(1, [("Head", False)]), (0, [("text ", False), ("bold", True), (" more line", False)])]
    assert blocks.select(DOC.to_plain_text(F.col("b"), shout=True)).first()[0] == "HEAD\n\ntext bold more line"
    DOC.write_results(text, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    n = rows(spark, ["“a”  é x", None]).select(DOC.normalize_for_match(F.col("text")).alias("n")).collect()
    assert n[0].n.norm == '"a" é x' and n[0].n.offsets == [0, 1, 2, 3, 5, 7, 8] and n[1].n.norm == ""
    assert DOC.truncate_long(rows(spark, ["abc", None]), 2).filter("truncated").first().text == "ab"
    ok, no = DOC.language_gate(rows(spark, ["a", "b"]).withColumn("lang", F.when(F.col("doc_id") == 0, "en")))
    assert ok.count() == 1 and no.first().reason == "Language is unknown, not en"
    assert [r.length_guard for r in DOC.short_text_gate(rows(spark, ["w " * 100, "w " * 200, "w " * 500])).orderBy("doc_id").collect()] == ["insufficient", "short", None]


def test_offsets_of_composed_texts(spark):
    """Composed and other texts have the offsets of the plain search, in pieces of few characters."""
    texts = ["  a \u3000\tb\n", "“é” x\u00a0\u2003 y", "a\u0301 b\u0323\u0307", "\u2000\u2001 z", "𝒳 \ufeff‘q’", "x \u0301y", "", " ", "plain"] * 3
    got = rows(spark, texts).coalesce(1).select("doc_id", DOC.normalize_for_match(F.col("text")).alias("n")).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        parts = [m for m in re.finditer(f"{WS}+|(?!{WS}).[\u0300-\u036f]*", t, re.S)]
        plain = [(m.start(), c) for m in parts for c in (" " if re.match(WS, m[0]) else unicodedata.normalize("NFC", m[0]))]
        assert r.n.offsets == [i for i, _ in plain]
        assert r.n.norm == "".join(c for _, c in plain).translate(str.maketrans("‘’“”", "''\"\""))


def test_letter_language_as_plain_ranks(spark):
    """The plain ranking, for long, repeated, pooled, letterless and rare texts; rows aren't spread out by sequence."""
    rng = random.Random(6)
    words = {"x": ["der", "die", "Straße", "über"], "y": ["the", "of", "ship"], "z": ["𝒳𝒴", "𝒳o", "été"]}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    docs = [(i, "xyz"[i % 3], text("xyz"[i % 3], 40)) for i in range(30)]
    docs += [(30, None, text("x", 60_000)), (31, None, None), (32, None, "12 - 3"), (33, None, "qqq"), (33, None, text("y", 9)), (33, None, text("y", 9)), (34, None, ""), (34, None, text("z", 9)), (None, None, "the ship")]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")

    def ranks(texts, top=20):
        n = {}
        for t in texts:
            p = re.sub("_+", "_", "_" + re.sub(r"[\W\d_]+", "_", (t or "").lower()) + "_")
            for i in range(len(p) - 2):
                n[p[i : i + 3]] = n.get(p[i : i + 3], 0) + 1
        return {g: i + 1 for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:top])}

    profiles = {k: ranks([t for _, own, t in docs if own == k]) for k in "xyz"}
    out = C.detect_language(frame, C.language_profiles(frame, top=20), top=20)
    assert {(r.lang, r.gram): r["rank"] for r in C.language_profiles(frame, top=20).collect()} == {(k, g): i for k in profiles for g, i in profiles[k].items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan  # of the repeated doc_id
    once = C.detect_language(frame.filter("doc_id < 33"), C.language_profiles(frame, top=20), top=20)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Join" not in plan
    assert {r.doc_id: r.lang_pred for r in once.collect()} == {r.doc_id: r.lang_pred for r in out.collect() if r.doc_id is not None and r.doc_id < 33}
    want = []
    for doc_id, *_ in docs:
        own = ranks([t for d, _, t in docs if d == doc_id])
        gains = [(sum(abs(own[g] - i) - 20 for g, i in profiles[k].items() if g in own), k) for k in "xyz" if own.keys() & profiles[k].keys()]
        want.append((doc_id, min(gains)[1] if gains and doc_id is not None else None))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_pieces_are_bounded(monkeypatch):
    """A batch goes to a helper in pieces, so no more than some texts' results are held at once."""
    monkeypatch.setattr(batches, "CHARS", 10)
    texts = ["aaaa", "bbbb", None, "cccc", "d" * 30, "e", ["f" * 6, None, "g" * 6], ["h"]]
    assert [p.tolist() for p in batches.pieces(iter([pd.Series(texts), pd.Series(["x"])]))] == [["aaaa", "bbbb", None], ["cccc"], ["d" * 30], ["e"], [["f" * 6, None, "g" * 6]], [["h"]], ["x"]]
    assert [len(p) for p in batches.pieces(iter([pd.Series([], dtype=object)]))] == [0]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"We utilize {i} tools — in order to win.\n\nThe landscape was written; so it is.") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = rewrite_stream(stream, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    key = lambda r: r.doc_id
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(rewrite_stream(docs, RULES).collect(), key=key)
