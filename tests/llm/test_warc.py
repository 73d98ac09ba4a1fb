"""Archives read back, by our reader and by gzip."""

import gzip
import hashlib
import io

import pytest

from haptrace.llm import warc

BIG = "<html>" + "é" * 600 + "</html>"
ROWS = [(1, "http://a/ x\r\ny", BIG, 0), (7, "http://b/", BIG, 0), (3, None, BIG, 0), (4, "u", "small", 0), (5, "u", "small", 0), (6, "u", None, 0),
        (8, "u", "", 0), (None, "n", BIG, 0), (None, "n", "<p>" + "z" * 2000, 0), (9, "u", "\r\n\r\n" * 400, 0), (10, "v", "WARC/1.1\r\n" * 30_000, 0),
        (7, "http://b/", BIG, 0), (-2, "neg", "q" * 999, 0), (-1, "neg", "q" * 999, 0), (-5, "neg", "r" * 1000, 0), (-4, "neg", "r" * 1000, 0)]
SCHEMA = "page_id long, url string, html string, payload int"


def test_round_trip(spark):
    roles = warc.with_roles(spark.createDataFrame(ROWS, SCHEMA), "page_id", "url", "html")
    archives = warc.write(roles, warc.shared_folder(spark, "warc"), archive_bytes=400)
    listed = archives.collect()
    assert sum(r["records"] for r in listed) == len(ROWS) and len(listed) > 4
    found = warc.read(archives).collect()
    big = {7, -4}
    for r in found:
        texts = [(q[2] or "").encode() for q in ROWS if q[0] == r["page_id"]]
        data = next(t for t in texts if hashlib.sha1(t).hexdigest() == r["payload_digest"])
        assert r["payload_bytes"] == len(data)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] in big
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in found if r["record_type"] == "revisit")
    assert kinds == [(-5, "revisit", -4), (0, "revisit", 7), (1, "revisit", 7), (3, "revisit", 7)]
    assert [r["url"] for r in found if r["page_id"] == 1] == ["http://a/%20x%0D%0Ay"]


def test_each_record_is_a_gzip_member(tmp_path, spark):
    parts = [warc.member(warc.record(i, f"u{i}", b"x" * i * 40_000, None, None)) for i in range(4)]
    joined = b"".join(parts)
    assert gzip.decompress(joined).count(b"WARC-Type: response") == 4
    assert [len(r["payload"]) for r in warc.records(io.BytesIO(joined))] == [0, 40_000, 80_000, 120_000]
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(joined[:-9])))
    broken = warc.member(warc.record(1, None, b"payload", None, None).replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken)))


def test_empty_table(spark):
    archives = warc.write(warc.with_roles(spark.createDataFrame([], SCHEMA), "page_id", "url", "html"), warc.shared_folder(spark, "warc"))
    assert archives.collect() == [] and warc.read(archives).collect() == []
