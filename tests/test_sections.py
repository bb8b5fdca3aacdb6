import random

from prose_audit.operators import scoring, sections
from prose_audit.sources.rules import default_rules

SCHEMA = "doc_id long, text string"
FINDING = "doc_id long, id string, start int, end int, severity int"


def rules():
    out = default_rules()
    out.flags = [("alpha", "Marketing hype", "Cut", None, None), ("beta", "Vague connective", "Cut", None, None)]
    return out


def sentence(rng, n):
    return " ".join(rng.choices(["word", "other", "alpha", "beta", "more", "I"], weights=[9, 9, 1, 1, 9, 1], k=n)).capitalize() + "."


def texts(seed):
    rng, rows = random.Random(seed), []
    for k in range(6):
        paragraphs = []
        for i in range(rng.randrange(20, 40)):
            if k % 2 and i % 7 == 0:
                paragraphs.append(f"# Heading {i}")
            paragraphs.append(" ".join(sentence(rng, rng.randrange(3, 20)) for _ in range(rng.randrange(1, 6))))
        rows.append((k, "\n\n".join(paragraphs)))
    return rows


def test_flags_meet_their_sentences(spark):
    """Against a search over all sentences for each flag."""
    rows = texts(1)
    df = spark.createDataFrame(rows, SCHEMA)
    at = sections.located(df, rules(), least=0).collect()
    for doc_id, _ in rows:
        own = sorted((r for r in at if r.doc_id == doc_id and r.side == 0), key=lambda r: (r.para_idx, r.start))
        assert [r.sentence for r in own] == list(range(len(own)))
        heads = sum(r.head for r in own)
        seen = words = 0
        for r in own:
            seen += r.head
            assert r.section == (seen if heads else words // 400)
            words += r.n
        for f in (r for r in at if r.doc_id == doc_id and r.side == 1):
            before = [r for r in own if (r.para_idx, r.start) <= (f.para_idx, f.start)]
            assert (f.sentence, f.section) == (before[-1].sentence, before[-1].section)
            assert f.sentence_end == (before[-1].end if before[-1].para_idx == f.para_idx else None)


def test_section_scores(spark):
    df = spark.createDataFrame([*texts(2), (None, None), (9, ""), (10, "alpha " * 2000)], SCHEMA)
    out = sections.section_scores(df, rules(), least=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = out.collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, 10}
    for r in rows:
        mean = [x.total for x in rows if x.doc_id == r.doc_id]
        assert abs(r.doc_mean - sum(mean) / len(mean)) < 1e-9 and r.deviates == (abs(r.total - r.doc_mean) > 4)
        assert r.total == int((r.d1 + r.d2 + r.d3 + r.d4 + r.d5) * 10 + 0.5) / 10
    assert sections.section_scores(spark.createDataFrame([], SCHEMA), rules()).collect() == []


def plain_fold(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[4] or 0), r[2] - r[3], r[2], r[3], r[1])):
        if not any(a < r[3] and r[2] < b for a, b in kept):
            kept.append((r[2], r[3]))
    return sorted(kept)


def test_findings_against_the_plain_fold(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(20):
        for k in range(rng.randrange(60)):
            a = rng.randrange(200)
            rows.append((doc, f"{doc}-{k}", a, a + rng.randrange(0, 12), rng.choice([None, 1, 2, 3])))
    got = scoring.resolve_findings(spark.createDataFrame(rows, FINDING)).collect()
    for doc in range(20):
        assert sorted((r.start, r.end) for r in got if r.doc_id == doc) == plain_fold([r for r in rows if r[0] == doc])
    assert scoring.resolve_findings(spark.createDataFrame([], FINDING)).collect() == []


def test_many_findings_in_a_document(spark):
    """100,000 findings, one island of 50,000 among them, in seconds."""
    rows = [(1, f"a{k}", 2 * k, 2 * k + 3, k % 3) for k in range(50_000)] + [(1, f"b{k}", 200_000 + 5 * k, 200_000 + 5 * k + 4, 1) for k in range(50_000)]
    got = {(r.start, r.end) for r in scoring.resolve_findings(spark.createDataFrame(rows, FINDING)).collect()}
    assert all((r[2], r[3]) in got for r in rows[50_000:])
    ends = -1
    for a, b in sorted(got):
        assert a >= ends
        ends = b
    # every finding of the highest severity that stands first, and none that a more severe one overlaps
    want = {(r[2], r[3]) for r in rows[:50_000] if r[4] == 2}
    assert want <= got
