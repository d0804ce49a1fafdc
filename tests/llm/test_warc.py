import gzip
import hashlib

import pytest

from callmetrics.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def rows():
    made = [(i, f"https://m.h{i % 3}.example.org/p/{i}?q={i}", f"<p>{i % 40}</p>\r\n\r\nWARC/1.1 é", "x") for i in range(200)]
    return made + [(500, None, None, ""), (501, "http://x.org/\r\nA: b", "", ""), (None, "no url", "lone", ""), (7, "https://twice.org/", "same", ""), (7, "https://twice.org/", "same", ""), (8, "https://third.org/", "same", "")]


def test_write_and_read_back(spark, tmp_path):
    capture = warc.write(spark.createDataFrame(rows(), SCHEMA), folder=f"file://{tmp_path}/warc", block_lines=7)
    got = warc.read_all(capture).collect()
    assert len(got) == len(rows())
    first = {}
    for page, _, html, _ in rows():
        key = html or ""
        first[key] = page if key not in first else min(first[key], page)
    want = sorted(
        (page if page is not None else -1, len((html or "").encode()), warc.base32_sha1((html or "").encode()), "response" if first[html or ""] == page else "revisit", None if first[html or ""] == page else first[html or ""])
        for page, _, html, _ in rows()
    )
    key = lambda r: (r[0], r[1], r[2], r[3], r[4] if r[4] is not None else -1)
    have = [(r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_lookup_by_binary_search(spark, tmp_path):
    capture = warc.write(spark.createDataFrame(rows(), SCHEMA), folder=str(tmp_path / "w"), block_lines=5)
    urls = ["https://m.h1.example.org/p/100?q=100", "https://twice.org/", "https://nowhere.org/", "no url", None]
    got = warc.lookup(spark, capture, spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert sorted((r.page_id if r.page_id is not None else -1) for r in got) == [-1, 7, 7, 100, 500]
    assert {bytes(r.payload) for r in got if r.page_id == 7} == {b"same"}


def test_archives_are_gzip_members_of_warc_records(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", ""), (2, "http://a.b/2", "<p>x</p>", "")], SCHEMA), folder=str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w/archive").glob("*.warc.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"WARC-Type: revisit") == 1 and data.endswith(b"\r\n\r\n")


def test_keys_small_payloads_and_empty(spark, tmp_path):
    assert warc.url_key("https://www.A.Example.org:8080/X?y=1") == "org,example,a:8080)/X?y=1"
    assert warc.url_key("urn:x-none:") == "urn:x-none:"
    capture = warc.write(spark.createDataFrame(rows(), SCHEMA), folder=str(tmp_path / "a"), revisit_from=10)
    assert {r.record_type for r in warc.read_all(capture).where("payload_bytes < 10").collect()} == {"response"}
    capture = warc.write(spark.createDataFrame([], SCHEMA), folder=str(tmp_path / "b"))
    assert warc.read_all(capture).count() == 0


def test_damage_is_found(spark, tmp_path):
    data, digest = warc.record(1, "http://a/", b"payload", None, False, "2000-01-01T00:00:00Z")
    fields, http, payload = warc.parse_record(gzip.compress(data))
    assert payload == b"payload" and http["Content-Length"] == "7" and fields["Page-Id"] == "1"
    assert digest == warc.base32_sha1(b"payload") and len(hashlib.sha1(b"").digest()) == 20
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(data[:-4]))


def test_fetch_bisects_to_the_blocks_of_its_keys(spark, tmp_path):
    made = [(i, f"https://h{i % 5}.org/{i:04d}", f"p{i}", "") for i in range(300)] + [(1000 + i, "https://h2.org/hot", f"hot{i}", "") for i in range(90)]
    capture = warc.write(spark.createDataFrame(made, SCHEMA), folder=str(tmp_path / "w"), block_lines=8)
    ranges = sorted((tuple(r) for r in capture.shards.select("first_key", "last_key", "path", "at", "length").collect()), key=lambda x: x[:2])
    every = [(path, a, n) for _, _, path, at, length in ranges for _, a, n in warc._directory(path, at, length)]
    lines = {b: warc._block(*b) for b in every}
    for key in sorted({x[0] for held in lines.values() for x in held}) + ["", "zzz", "org,h2)/0000"]:
        found = list(warc.blocks_of(key, ranges, [r[1] for r in ranges], warc._directory))
        assert {b for b in every if any(x[0] == key for x in lines[b])} <= set(found) and len(found) <= 2 + 90 // 8 + len(ranges)
    pages = spark.createDataFrame(made, SCHEMA)
    got = warc.fetch(capture, warc.keys_of(pages)).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == sorted((p, h) for p, _, h, _ in made)
