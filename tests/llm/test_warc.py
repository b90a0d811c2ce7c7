import gzip
import hashlib
import base64

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import warc as W


def pages():
    out = [(i, f"http://h{i % 3}/p é?{i}", ("<p>%d</p>" % (i % 7) * (i % 5) + "é").encode()) for i in range(60)]
    return out + [(100, None, b""), (101, "u\r\nv", b""), (102, "http://big", b"x\r\n\r\nWARC/1.1\r\n" * 40000), (None, "n", b"none"), (103, "m", b"none")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    df = spark.createDataFrame(pages(), "page_id long, url string, payload binary").withColumn("refers_to", F.lit("clash"))
    path = str(tmp_path_factory.mktemp("warc") / "a")
    W.write_archives(W.mark_revisits(df).repartition(3), path, file_bytes=3000)
    return path


def test_round_trip(spark, archive):
    top = {}
    for k, _, p in pages():
        if k is not None:
            top[p] = max(top.get(p, k), k)
    want = sorted((f"{W.PAGE}{k}", "response" if k == top[p] else "revisit", None if k == top[p] else f"{W.PAGE}{top[p]}", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for k, _, p in pages())
    got = W.read_archives(spark, archive, verify="true").filter(F.col("record_type").isin("response", "revisit")).collect()
    want = sorted((a.replace("None", "None"), *b) for a, *b in want)
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_length, r.payload_digest) for r in got) == want
    body = {f"{W.PAGE}{k}": p for k, _, p in pages()}
    assert all(bytes(r.payload) == (body[r.record_id] if r.record_type == "response" else b"") for r in got)


def test_predicates_are_pushed_and_unwanted_payloads_skipped(spark, archive, monkeypatch):
    reader = W.WarcReader({"path": archive}, type("S", (), {"names": ["record_id", "record_type"]}))
    kept = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.StringStartsWith(("target_uri",), "http://h1/"), W.EqualTo(("payload",), b"x")]))
    assert len(kept) == 1 and len(reader.tests) == 2
    parts = reader.partitions()
    with monkeypatch.context() as m:
        m.setattr(W.zlib, "decompress", lambda *_: 1 / 0)  # whole members must not be inflated
        rows = [r for p in parts for r in reader.read(p)]
    want = W.read_archives(spark, archive).filter("record_type = 'revisit' AND startswith(target_uri, 'http://h1/')").count()
    assert len(rows) == want > 0
    plan = W.read_archives(spark, archive, "record_id string, record_type string").filter("record_type = 'response' AND record_id IN ('urn:page:3', 'urn:page:102')")
    assert {r.record_id for r in plan.collect()} <= {"urn:page:3", "urn:page:102"}


def test_files_are_planned_by_size(archive):
    reader = lambda n: W.WarcReader({"path": archive, "split_bytes": n}, type("S", (), {"names": []}))
    many, one = reader(1).partitions(), reader(1 << 30).partitions()
    assert len(one) == 1 and len(many) == len(one[0].paths) > 3


def test_plain_files_and_members_without_length(spark, tmp_path):
    recs = [W.page_record(i, "u", b"<p>\r\n\r\n" * i, None, False) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    (tmp_path / "_c.warc").write_bytes(b"garbage")
    got = W.read_archives(spark, str(tmp_path), verify="true").collect()
    assert sorted(len(r.payload) for r in got) == sorted(2 * [7 * i for i in range(4)])


def test_a_damaged_payload_is_found(spark, tmp_path):
    rec = W.page_record(1, "u", b"abcdef", None, False).replace(b"abcdef", b"abcdeX")
    (tmp_path / "a.warc").write_bytes(rec)
    assert W.read_archives(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="does not match"):
        W.read_archives(spark, str(tmp_path), verify="true").collect()


def test_empty_and_thresholds(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", b"x"), (2, "b", b"x"), (2, "b", b"x"), (3, "c", b"")], "page_id long, url string, payload binary")
    got = sorted((r.page_id, r.is_revisit, r.refers_to) for r in W.mark_revisits(df, min_bytes=1).collect())
    assert got == [(1, True, 2), (2, False, None), (2, False, None), (3, False, None)]
    W.write_archives(W.mark_revisits(df.limit(0)), str(tmp_path / "e"))
    assert W.read_archives(spark, str(tmp_path / "e")).filter("record_type = 'response'").count() == 0
