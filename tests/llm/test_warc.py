import base64
import hashlib
import io

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from prose_audit.llm import warc

PAGES = [
    (4, "http://a.example/x", "same é"), (2, "http://b.example/", "same é"), (9, None, "same é"), (1, "http://c.example/%25\n?q", "alone"),
    (5, "u", None), (6, "u", ""), (7, "http://d.example", "x" * 300_000), (3, "u3", "same é"), (2, "http://b.example/", "same é"), (None, "n", "alone"), (None, "n", "no id"),
]


def test_captures(spark):
    df = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(warc.captures(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_digest))
    want = []
    for page, url, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        revisit = first is not None and page != first
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [tuple(r)[:5] for r in got] == want
    assert all(r.request_id and r.metadata_id for r in got)
    assert len({r.response_id for r in got}) == len(PAGES)
    assert warc.captures(df.limit(0)).count() == 0


def test_smaller_payloads_are_responses(spark):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    assert {r.record_type for r in warc.captures(df, min_revisit_bytes=100).collect()} == {"response"}


def test_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES[:8], "page_id long, url string, html string")
    rows = warc.assemble(warc.read_warc(warc.write_warc(df), with_payload=True)).collect()
    html = {p: h or "" for p, _, h in PAGES[:8]}
    for r in rows:
        if r.response.type == "response":
            assert r.response.payload.decode() == html[r.page_id]
            assert r.request.record_id and r.metadata.page_id == r.page_id


def test_orphans_and_rolls(spark, monkeypatch):
    records = spark.createDataFrame([("request", "q", "gone"), ("metadata", "m", None), ("response", "r", None)], "type string, record_id string, concurrent_to string")
    for c in warc.RECORD_SCHEMA.split(", "):
        name, kind = c.split()
        if name not in records.columns:
            records = records.selectExpr("*", f"cast(null as {kind}) {name}")
    [row] = warc.assemble(records).collect()
    assert row.response.record_id == "r" and row.request is None and row.metadata is None
    data = b"".join(warc.record("response", f"<{i}>", {}, b"x" * i) for i in range(40))
    assert len(list(warc.members(io.BytesIO(data), 7))) == 40


def test_a_task_that_runs_twice_keeps_the_committed_archives(spark, tmp_path, monkeypatch):
    """The second attempt has the rows in another order and other cuts; the first one's manifest still reads whole."""
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    first = warc.write_warc(df, folder=f"file://{tmp_path}/w")
    kept = first.collect()
    back = df.orderBy(F.desc("page_id")).coalesce(1)
    names = warc.NAMES
    other = [r for r in warc.write_warc(back, folder=f"file://{tmp_path}/w2").collect()]
    assert names == warc.NAMES and len(kept) > 3 and len({r.path for r in kept}) == len(kept)
    assert all(r.path.rsplit("-", 2)[1].isdigit() and r.path.endswith(".warc.gz") for r in kept + other)
    # the same folder and partition again: nothing of the first attempt is overwritten
    again = df.sparkSession.createDataFrame(back.rdd, back.schema).coalesce(1)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **k: self.format("noop").mode("overwrite").save())
    try:
        warc.write_warc(again, folder=f"file://{tmp_path}/w")
    except Exception:  # its manifest isn't written, as for an attempt that isn't committed
        pass
    monkeypatch.undo()
    assert sorted(r.page_id for r in warc.assemble(warc.read_warc(first)).collect()) == list(range(40))
