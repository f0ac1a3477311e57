"""Archives: exact round trip, segments, chunked framing and faults."""

import hashlib

import pytest
from pyspark.sql import functions as F

from motionframe.llm import archives

PAGES = "page_id long, url string, html string, digest string, n int"


def test_round_trip(spark, tmp_path):
    big = "päge \r\n\r\nWARC/1.1 " * 3000
    html = {1: "x" * 99, 2: "x" * 99, 3: "y" * 100, 4: "y" * 100, 5: None, 6: "", 7: big, 8: big, 9: "é" * 50, 10: "0\r\n\r\n"}
    rows = [(k, f"http://h/{k} \n", v, "d", 1) for k, v in html.items()] + [(3, None, "y" * 100, "d", 1), (None, "u", "y" * 100, "d", 1)]
    got = archives.archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / "w")).collect()
    want, seen = [], set()
    for k, _, v, _, _ in rows:
        v = (v or "").encode()
        first = min((r[0] for r in rows if (r[2] or "").encode() == v and r[0] is not None), default=None)
        fresh = len(v) < 100 or (k == first and k not in seen)
        seen.add(k)
        want.append((k, len(v), hashlib.sha256(v).hexdigest(), "response" if fresh else "revisit", None if fresh else first))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    records = archives.read_records(spark, str(tmp_path / "w"))
    assert records.where("origin LIKE 'urn:page:=7:%'").count() == -(-len(archives.chunked(big.encode())) // archives.SEGMENT_BYTES)


def test_text_keys(spark, tmp_path):
    """Keys with colons, spaces, line ends and other scripts; an empty key is not a NULL one."""
    keys = ["a:b", "a:c", "", None, "x y+%3A", "ü:\r\n", "plain"]
    rows = [(k, "u", ("same " * 30) if i % 2 else f"own {i} " * 30) for i, k in enumerate(keys)]
    got = archives.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "w")).collect()
    first = min(k for k, _, v in rows if v.startswith("same") and k is not None)
    want = [(k, "revisit" if v.startswith("same") and k != first else "response", first if v.startswith("same") and k != first else None) for k, _, v in rows]
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in got) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    assert archives.archive_round_trip(spark.createDataFrame([], PAGES), str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunked_framing(size):
    payload = bytes(range(256)) * 3
    assert archives.dechunked(archives.chunked(payload, size)) == payload
    assert archives.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            archives.dechunked(broken)


def test_faulty_segments_are_named(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "z" * 50_000, "d", 1)], PAGES)
    archives.write_archives(df, str(tmp_path / "w"))
    records = archives.read_records(spark, str(tmp_path / "w"))
    fault = lambda rows: archives.reassemble(rows).first().fault
    assert fault(records) is None
    assert fault(records.where("segment <> 3")) == "segments missing or repeated"
    assert fault(records.union(records.where("segment = 2"))) == "segments missing or repeated"
    last = records.agg(F.max("segment")).first()[0]
    assert fault(records.where(F.col("segment") < last)) == "no total length"
    short = records.withColumn("block", F.expr("CASE WHEN segment = 2 THEN substring(block, 1, 9) ELSE block END"))
    assert fault(short) == "total length differs"
    spoiled = records.withColumn("block", F.expr("CASE WHEN segment = 2 THEN cast(replace(cast(block AS string), 'z', 'q') AS binary) ELSE block END"))
    assert fault(spoiled) == "payload digest differs"
