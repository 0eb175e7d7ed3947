from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from rowsmith.llm import warc

SCHEMA = "page_id long, url string, html string, record_type int"
ROWS = [(5, "http://a", "<p>x</p>", 1), (3, "http://b", "<p>x</p>", 1), (9, "http://c\nx", "é" * 50_000, 1), (4, None, None, 1), (8, "http://d", "", 1), (10, "http://e", "a\r\n\r\nb" * 10, 1)]


def test_round_trip_and_revisits(spark):
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("response", None), 4: ("response", None), 8: ("revisit", 4), 10: ("response", None)}
    for i, _, html, _ in ROWS:
        payload = (html or "").encode()
        assert out[i].payload_bytes == len(payload) and out[i].payload_digest == warc.base32_sha1(payload) and out[i].intact
        assert out[i].read_sha1 in (None, hashlib.sha1(payload).hexdigest()) and (out[i].read_sha1 is None) == (out[i].record_type == "revisit")


def test_least_bytes_repeated_rows_and_empty(spark, tmp_path):
    df = spark.createDataFrame([*ROWS, ROWS[1]], SCHEMA)
    warc.write_warc(df, str(tmp_path / "a"), least=8).count()
    rows = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(3, "response"), (3, "revisit"), (4, "response"), (5, "revisit"), (8, "response"), (9, "response"), (10, "response")]
    warc.write_warc(df.limit(0), str(tmp_path / "b")).count()
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == 0


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path)).count()
    df = warc.read_warc(spark, str(tmp_path))
    assert [r.page_id for r in df.where("record_type = 'revisit' and page_id in (5, 3)").collect()] == [5]
    assert df.where("page_id = 9").first().payload == ("é" * 50_000).encode()
    assert all(r.payload is None for r in warc.read_warc(spark, str(tmp_path), payload=False).collect())
    reader = warc.WarcReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")]))
    assert len(kept) == 1 and len(reader.filters) == 1


@pytest.mark.parametrize("compressed", [False, True])
def test_headers_first(compressed):
    parts = [warc.record(i, f"u{i}", "response", "D", None, 3, b"abc") for i in range(5)]
    raw = b"".join(gzip.compress(p) if compressed else p for p in parts)
    rows = list(warc.read_records(io.BytesIO(raw), compressed, lambda r: r["page_id"] % 2 == 0, True))
    assert [(r[0], r[-1]) for r in rows] == [(0, b"abc"), (2, b"abc"), (4, b"abc")]


def test_a_wrong_digest_is_found(tmp_path):
    right = warc.record(1, "http://a", "response", warc.base32_sha1(b"abc"), None, 3, b"abc")
    wrong = warc.record(2, "http://b", "response", warc.base32_sha1(b"abd"), None, 3, b"abc")
    assert len(list(warc.read_records(io.BytesIO(right), False, lambda row: True, True, verify=True))) == 1
    assert len(list(warc.read_records(io.BytesIO(wrong), False, lambda row: True, True))) == 1
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(right + wrong), False, lambda row: True, True, verify=True))
