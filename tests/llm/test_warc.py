import gzip
import hashlib

import pytest

from lexmill.llm import warc


def record(n, payload, kind="response"):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    block = http + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


PAYLOADS = [b"", b"<p>one</p>", b"\x00\xff\x1f\x8b\x08 WARC/1.1\r\nnot a record\r\n\r\n", record(9, b"inner"), b"x" * 5000]


def read(raw):
    out = list(warc.salvage(raw))
    return [bytes(f["payload"]) for _, _, p, f in out if not p], [(o, n) for o, n, p, _ in out if p]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_whole_archive(pack):
    raw = b"".join(pack(record(i, p)) for i, p in enumerate(PAYLOADS))
    assert read(raw) == (PAYLOADS, [])


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("bad", range(5))
def test_damage_costs_one_record_and_is_logged(pack, bad):
    parts = [pack(record(i, p)) for i, p in enumerate(PAYLOADS)]
    lost = bytearray(parts[bad])
    lost[-12] ^= 0x55  # inside the block, or the compressed data
    raw = b"".join([*parts[:bad], bytes(lost), *parts[bad + 1 :]])
    payloads, gaps = read(raw)
    assert [p for p in PAYLOADS[:bad] + PAYLOADS[bad + 1 :] if p not in payloads] == []
    start = sum(map(len, parts[:bad]))
    assert gaps and gaps[0][0] == start and sum(n for _, n in gaps) <= len(lost)


def test_truncation_garbage_and_missing_bytes():
    a, b, c = (record(i, p) for i, p in enumerate([b"a" * 100, b"b" * 100, b"c" * 100]))
    assert read(a + b[:-60]) == ([b"a" * 100], [(len(a), len(b) - 60)])
    assert read(b"junk" + a + b"\x1f\x8b\x08 more junk" + c) == ([b"a" * 100, b"c" * 100], [(0, 4), (4 + len(a), 13)])
    assert read(a[:-40] + a[-30:] + c) == ([b"c" * 100], [(0, len(a) - 10)])
    assert read(b"") == ([], []) and read(b"\r\n\r\n") == ([], [])


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    long = "é<b>" * 700
    rows = [(1, "http://a", long), (5, "http://b\r\nX: y", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 40), (9, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = "file://" + str(tmp_path / "w")
    warc.write_archives(pages, path, compress=compress)
    if compress:
        whole = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*")]
        assert sum(x.count(b"\r\nWARC-Type: re") for x in whole) >= len(rows)
    got = {int(r.page_id): r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, payload = got[page], (html or "").encode()
        assert (r.problem, r.payload_bytes, r.payload_digest) == (None, len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", "5") if page in (1, 3) else ("response", None))
        assert r.payload == (None if page in (1, 3) else payload)
    assert got[5].url == "http://b%0D%0AX: y" and got[3].url is None


def test_empty_table(spark, tmp_path):
    path = "file://" + str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_headers_of_any_length(spark, tmp_path, compress):
    html = "<p>same</p>" * 200
    urls = {1: "data:text/html," + "x" * 100_000, 2: "http://b/?" + "é" * 40_000, 3: "http://c"}
    pages = spark.createDataFrame([(i, u, html) for i, u in urls.items()], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write_archives(pages, path, compress=compress)
    got = {int(r.page_id or -1): r for r in warc.read_archives(spark, path).collect()}
    assert {i: (r.url, r.problem) for i, r in got.items()} == {i: (u, None) for i, u in urls.items()}
    assert got[1].refers_to == got[2].refers_to == "3" and got[3].record_type == "response"


def test_members_are_read_in_linear_time():
    import random
    import time

    noise = random.Random(3)
    parts = [gzip.compress(record(i, noise.randbytes(30_000) + b"a" * 30_000), 1) for i in range(2048)]
    raw = b"".join(parts)
    began = time.process_time()
    found = [(o, n) for o, n, p, _ in warc.salvage(raw) if not p]
    assert time.process_time() - began < 10 and [n for _, n in found] == [len(x) for x in parts]
