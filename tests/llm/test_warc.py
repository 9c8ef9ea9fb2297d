"""WARC archives, written and read."""

import gzip

import pytest
from pyspark.sql import functions as F

from lodestone.llm.warc import MANIFEST, WarcReader, digest, member, read_archives, read_back, record, write_archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, head string")


ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "http://d", "own ü"), (5, "http://e\r\nX: y", None), (6, "f", ""), (7, "g", "x" * 100_000), (8, "h", "WARC/1.1\r\n\r\nWARC-Type: response"), (None, "n", "own ü"), (None, "n", "nobody's")]


def test_round_trip(spark):
    path = write_archives(pages(spark, ROWS).repartition(3))
    got = {(r.page_id, r.payload_digest): r for r in read_archives(spark, path).collect()}
    assert len(got) == len(ROWS)
    for i, url, html in ROWS:
        html = html or ""
        r = got[i, digest(html.encode())]
        same = [j for j, _, h in ROWS if (h or "") == html and j is not None]
        head = max(same, default=None)
        assert r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if head in (None, i) else ("revisit", head))
        assert r.payload == (html if r.record_type == "response" else None)
        assert r.target_uri == (url if url is None or "\r" not in url else "http://e%0D%0AX:%20y")


def test_small_payloads_may_all_be_responses(spark):
    path = write_archives(pages(spark, ROWS), least=5)
    kinds = {r.page_id: r.record_type for r in read_archives(spark, path, payload=False).collect()}
    assert kinds[1] == kinds[2] == "response" and kinds[5] == "response"


def test_filters_are_decided_from_the_header(spark):
    path = write_archives(pages(spark, ROWS))
    df = read_archives(spark, path).where((F.col("record_type") == "revisit") & F.col("page_id").isin(1, 2, 7))
    assert sorted(r.page_id for r in df.collect()) == [1, 2]
    assert "Filter " not in df._jdf.queryExecution().executedPlan().toString()


def test_archives_of_others(tmp_path):
    """Without lengths in the packed members, and not packed at all."""
    records = [record("response", 1, "http://a", b"payload one" * 1000, None), record("revisit", 2, "http://b", b"payload one" * 1000, 1), record("response", 3, None, b"", None)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(member, records)))
    assert gzip.decompress(member(records[0])) == records[0]
    for size in ("1", "100000000"):
        reader = WarcReader({"path": str(tmp_path), "partition_bytes": size})
        found = [r for p in reader.partitions() for r in reader.read(p)]
        assert [r[2] for r in found] == [1, 2, 3] * 3 and len(reader.partitions()) == (3 if size == "1" else 1)
        assert all(r[-1] == ("payload one" * 1000 if r[2] == 1 else None if r[2] == 2 else "") for r in found)


def test_empty_and_repeated(spark):
    assert read_archives(spark, write_archives(pages(spark, []))).collect() == []
    got = read_archives(spark, write_archives(pages(spark, [(1, "a", "x"), (1, "a", "x"), (0, "b", "x")]))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


@pytest.mark.parametrize("payload", [True, False])
def test_payload_option(spark, payload):
    path = write_archives(pages(spark, ROWS[:2]))
    assert sum(r.payload is not None for r in read_archives(spark, path, payload).collect()) == payload


def foreign(kind, block, *lines):
    return "\r\n".join(["WARC/1.0", "WARC-Type: response", f"Content-Type: {kind}", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_that_are_no_http_message(tmp_path):
    dns = b"20240101000000\nexample.org. 300 IN A 192.0.2.1\n"
    records = [foreign("text/dns", dns, f"Content-Length: {len(dns)}", "X-Page: <urn:x-page:what>"), foreign("application/http; msgtype=response", b"HTTP/1.1 200 OK", "Content-Length: 15"), foreign("text/dns", b"", "Content-Length: many", "X-Payload-Length: few"), record("response", 4, None, b"last", None)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    reader = WarcReader({"path": str(tmp_path)})
    found = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[2], r[-1]) for r in found] == [(None, dns.decode()), (None, "HTTP/1.1 200 OK"), (None, ""), (4, "last")] * 2


def test_read_back_takes_lengths_and_digests_from_payloads(spark):
    path = write_archives(pages(spark, ROWS).repartition(3))
    want = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(spark, path).collect()}
    got = [tuple(r) for r in read_back(spark, path).collect()]
    assert set(got) == want and len(got) == len(ROWS)


def test_files_of_failed_attempts_are_not_read(spark):
    path = write_archives(pages(spark, ROWS[:3]))
    folder = path.removeprefix("file://")
    with open(f"{folder}/stray.warc.gz", "wb") as f:
        f.write(member(record("response", 99, None, b"stray", None)))
    assert {r.page_id for r in read_archives(spark, path).collect()} == {1, 2, 3}
    assert spark.read.parquet(f"{path}/{MANIFEST}").agg(F.sum("records")).first()[0] == 3
