import random

import pytest
from pyspark.sql import functions as F

from prose_audit.functions import sql as S
from prose_audit.operators import incremental as I
from prose_audit.operators import rewrite
from prose_audit.operators.flags import Reviewer
from prose_audit.sources import sinks
from prose_audit.sources.rules import default_rules

PARAGRAPH = "doc_id long, para_idx int, output string"
FLAG = "doc_id long, para_idx int, type string, found string, start int"


@pytest.fixture(scope="module")
def rules():
    out = default_rules()
    out.flags = [("alpha", "Marketing hype", "Cut", None, None), ("beta", "Vague connective", "Cut", None, None)]
    return out


def paragraphs(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "word", "we think;", "on 12.5", "Paris", "it was taken by"]
    return [(d, p, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(40))) + "."])) for d in range(30) for p in range(rng.randrange(6))]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_patched_equals_recomputed(spark, rules, tmp_path):
    """After edits, new, removed and moved paragraphs and dismissals; only what changed is looked at."""
    old = spark.createDataFrame(paragraphs(1), PARAGRAPH)
    I.paragraph_state(old, rules).write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    now = [(d, p, "alpha alpha new." if (d + p) % 7 == 0 else t) for d, p, t in paragraphs(1) if d != 3 and (d, p) != (5, 0)] + [(77, 0, "beta"), (4, 9, "We think so.")]
    new = spark.createDataFrame(now, PARAGRAPH)
    gone = [(d, p, "Word choice", t[a:b], a) for d, p, t in now if t and d % 2 for a, b, kind, *_ in Reviewer(rules).review(t) if kind == "Word choice"][::2]
    gone = spark.createDataFrame([*gone, *gone[:1], (1, 99, "Word choice", "x", 0)], FLAG)
    for dismissed in (None, gone):
        sums, changed = I.patched_sums(I.document_sums(state), state, new, rules, dismissed)
        whole = I.paragraph_state(new, rules, dismissed)
        order = whole.columns
        assert rows(changed.select(order)) == rows(whole) and rows(sums) == rows(I.document_sums(whole).select(sums.columns))
        assert rows(I.scored(sums)) == rows(I.scored(I.document_sums(whole)))
    before = {(d, p): t or "" for d, p, t in paragraphs(1)}
    todo = {(r.doc_id, r.para_idx) for r in I.changed_paragraphs(state, new).collect()}
    assert todo == {(d, p) for d, p, t in now if before.get((d, p)) != (t or "")}
    sums, same = I.patched_sums(I.document_sums(state), state, old, rules)
    assert rows(sums) == rows(I.document_sums(state)) and rows(same.select(state.columns)) == rows(state)


def test_stream_restarts(spark, rules, tmp_path):
    """What comes in between two runs is taken up once; a batch that runs again leaves its rows once."""
    docs = [(k, f"We utilize thing {k} in order to win.\n\nalpha — beta") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    schema, inbox, out, state = df.schema, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        stream = rewrite.rewrite_documents(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox), rules)
        done = stream.select("doc_id", rewrite.output_text().alias("output"))
        sinks.stream_to_folder(done, out, state).awaitTermination()
        return spark.read.parquet(out).select("doc_id", "output")

    want = rewrite.rewrite_documents(df, rules).select("doc_id", rewrite.output_text().alias("output"))
    df.filter("doc_id < 20").repartition(3).write.parquet(inbox)
    assert rows(run()) == rows(want.filter("doc_id < 20"))
    df.filter("doc_id >= 20").repartition(2).write.mode("append").parquet(inbox)
    assert rows(run()) == rows(want)
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) == 5
    commits[-1].unlink()  # as if the last batch had failed after its output
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink()
    assert rows(run()) == rows(want)


def test_partitioned_sink(spark, tmp_path):
    """Writing one source anew leaves the files of others; a filter reads one folder."""
    df = spark.range(1000).select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.col("id") * 2).alias("score"))
    path = str(tmp_path / "t")
    sinks.write_partitioned(df, path, ["source"], ["id"])
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("source=*/*.parquet") if "source=s1" not in str(p)}
    sinks.write_partitioned(df.filter("source = 's1'").withColumn("score", F.lit(7).cast("long")), path, ["source"], ["id"])
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("source=*/*.parquet") if "source=s1" not in str(p)}
    want = df.withColumn("score", F.when(F.col("source") == "s1", 7).otherwise(F.col("score")))
    assert rows(sinks.read_partitioned(spark, path, df)) == rows(want)
    one = sinks.read_partitioned(spark, path, df, F.col("source") == "s2")
    assert one.count() == 250 and "PartitionFilters: [isnotnull(source" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("\n", " ")
    assert all(f"source=s{k}" in str(p) for k in range(4) for p in (tmp_path / "t").glob(f"source=s{k}/*.parquet"))


def test_sql_functions(spark, rules):
    S.register(spark, rules)
    docs = spark.createDataFrame([(1, "We utilize alpha; it was taken by us. Next one."), (2, None), (3, "")], "doc_id long, text string")
    got = spark.sql("SELECT doc_id, f.type, f.found, f.start FROM {docs}, LATERAL prose_flags(text) AS f", docs=docs).collect()
    text = docs.first().text
    assert sorted((r.doc_id, r.type, r.found, r.start) for r in got) == sorted((1, k, found, a) for a, b, k, _, found, *_ in Reviewer(rules).review(text))
    assert len(got) >= 3
    assert [(r.number, r.sentence) for r in spark.sql("SELECT s.* FROM {docs}, LATERAL prose_sentences(text) AS s", docs=docs).collect()] == [(0, "We utilize alpha; it was taken by us."), (1, "Next one.")]
    assert [r[0] for r in spark.sql("SELECT prose_rewrite(text) FROM {docs} ORDER BY doc_id", docs=docs).collect()] == [text.replace("utilize", "use"), None, ""]
    assert spark.sql("SELECT count(*) FROM {docs}, LATERAL prose_splits(text) AS s WHERE s.kind IS NULL", docs=docs).first()[0] == 0


def test_changed_paragraphs_are_reviewed_once(spark, rules):
    """What is scored again is stored, so neither sums nor the state review it another time."""
    old = spark.createDataFrame([(d, p, "An alpha; it was seen.") for d in range(3) for p in range(2)], PARAGRAPH)
    new = old.withColumn("output", F.when(F.col("doc_id") == 1, "A beta;").otherwise(F.col("output")))
    gone = spark.createDataFrame([(2, 0, "Semicolon", ";", 8)], FLAG)
    state = sinks.stored(I.paragraph_state(old, rules), "state")
    sums, after = I.patched_sums(I.document_sums(state), state, new, rules, gone)
    for df in (sums, after):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()
    whole = I.paragraph_state(new, rules, gone)
    assert sorted(map(tuple, after.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    want = I.document_sums(whole)
    assert sorted(map(tuple, sums.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
