import base64
import gzip
import hashlib
import io

import odd
import pytest

from scatterloom.llm import warc
from scatterloom.scratch import scratch_path


def records(n):
    return [warc.record("response", f"urn:x:{i}", f"http://a/{i}", f"page {i} ".encode() * (i * 50 + 1), None, "2024-01-01T00:00:00Z") for i in range(n)]


def read(data: bytes):
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    return [r["record_id"] for r in found if r["gap"] is None], [(r["start"], r["end"]) for r in found if r["gap"]]


@pytest.mark.parametrize("plain", [False, True])
def test_damage_costs_only_what_it_hits(plain, monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 64)
    parts = [gzip.decompress(r) for r in records(6)] if plain else records(6)
    places = [sum(map(len, parts[:i])) for i in range(7)]
    ids = [f"urn:x:{i}" for i in range(6)]
    whole = b"".join(parts)
    assert read(whole) == (ids, [])
    for hit in range(6):  # a byte of the block is changed
        broken = bytearray(whole)
        broken[places[hit + 1] - 12] ^= 0xFF
        assert read(bytes(broken)) == (ids[:hit] + ids[hit + 1 :], [(places[hit], places[hit + 1])])
    assert read(whole[: places[5] + 20]) == (ids[:5], [(places[5], places[5] + 20)])  # cut short
    junk = b"\x1f\x8b\x08 WARC/1. junk" * 9
    assert read(junk + whole) == (ids, [(0, len(junk))])
    assert read(whole[: places[2]] + junk + whole[places[2] :]) == (ids, [(places[2], places[2] + len(junk))])
    assert read(whole[: places[2]] + whole[places[2] + 30 :])[0] == ids[:2] + ids[3:]  # bytes are missing
    assert read(junk) == ([], [(0, len(junk))])
    assert read(b"") == ([], [])


def test_members_of_several_records_and_wrong_payload_digest():
    two = gzip.compress(b"".join(gzip.decompress(r) for r in records(2)))
    assert read(two)[0] == ["urn:x:0", "urn:x:1"]
    text = gzip.decompress(records(1)[0])
    a = text.index(b"WARC-Payload-Digest: sha1:") + 26
    wrong = text[:a] + b"A" * 32 + text[a + 32 :]
    assert read(wrong + text) == (["urn:x:0"], [(0, len(wrong))])


@pytest.mark.parametrize("kept", [0, 1 << 20])
def test_members_are_read_record_by_record(kept, monkeypatch):
    monkeypatch.setattr(warc, "KEPT", kept)
    monkeypatch.setattr(warc, "WINDOW", 300)
    monkeypatch.setattr(warc, "MAX_RECORD", 3000)
    texts = [gzip.decompress(r) for r in records(6)]
    ids = [f"urn:x:{i}" for i in range(6)]
    member = gzip.compress(b"".join(texts))
    assert sum(map(len, texts)) > 3000 and read(member) == (ids, [])  # the bound is one of records
    long = gzip.compress(texts[0] + records_of_length(4000) + texts[1])
    assert read(long + member) == (ids[:2] + ids, [(0, len(long))])
    broken = bytearray(texts[2])
    broken[-8] ^= 0xFF
    part = gzip.compress(texts[1] + bytes(broken) + b"junk" + texts[3])
    assert read(part + member) == ([ids[1], ids[3], *ids], [(0, len(part))])
    wrong = bytearray(member)
    wrong[-8] ^= 0xFF  # the checksum
    assert read(bytes(wrong) + part) == ([*ids, ids[1], ids[3]], [(0, len(member)), (len(member), len(member) + len(part))])
    assert read(part + member[:-9])[0] == [ids[1], ids[3], *ids]
    unproved = gzip.compress(b"".join(texts).replace(b"WARC-Block-Digest", b"X-Block-Digest"))
    assert read(unproved) == (ids, []) and read(unproved[:-8] + bytes(8) + part)[0] == [ids[1], ids[3]]


def records_of_length(n):
    return gzip.decompress(warc.record("response", "urn:x:long", "http://a/", b"x" * n, None, "2024-01-01T00:00:00Z"))


def test_heads_of_any_length(spark):
    uri = "http://a/" + "é" * 100_000
    df = spark.createDataFrame([(1, uri, "a"), (2, "u", "b")], "page_id bigint, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(spark, df).collect()) == [1, 2]
    assert {r.target_uri for r in warc.read(warc.write(df, scratch_path(spark, "archives"))).collect()} == {uri, "u"}


@pytest.mark.parametrize("name", ["sha256", "sha1", "md5", "SHA-256", "xxh3"])
def test_digests_by_their_label(name):
    def with_digests(made, payload, block):
        text = gzip.decompress(warc.record("response", "urn:x:0", "http://a/", payload, None, "2024-01-01T00:00:00Z"))
        return text.replace(f"sha1:{warc.digest(payload)}".encode(), f"{name}:{made(payload)}".encode()).replace(f"sha1:{warc.digest(block)}".encode(), f"{name}:{made(block)}".encode())

    kind = name.lower().replace("-", "") if name != "xxh3" else "sha384"
    new = lambda x: hashlib.new(kind, x)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 4\r\n\r\npage"
    for made in (lambda x: new(x).hexdigest(), lambda x: new(x).hexdigest().upper(), lambda x: base64.b32encode(new(x).digest()).decode(), lambda x: base64.b64encode(new(x).digest()).decode()):
        sound = with_digests(made, b"page", block)
        assert sound.count(f"{name}:".encode()) == 2 and read(sound) == (["urn:x:0"], [])
        if name != "xxh3":
            assert read(with_digests(lambda x, f=made: f(x + b"!"), b"page", block)) == ([], [(0, len(sound))])


def test_round_trip_of_odd_pages(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "<p>é</p>", "x" * 300_000, "<p>a</p>", None, "<p>a</p>"]
    ids = [3, 4, 5, 1, 2**60 + 1, 6, 1, None, None]
    urls = [None, "http://a/b c\r\nX: y", "é", "", "u", "u", "u", None, "u"]
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in zip(ids, urls, html)], "page_id bigint, url string, html string, path string, id int").repartition(3)
    first = {}
    for i, h in zip(ids, html):
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, h in zip(ids, html):
        data, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert odd.collected(warc.round_trip(spark, df)) == sorted(want, key=repr)
    assert warc.round_trip(spark, df.limit(0)).collect() == []


def test_archives_rotate_and_payloads_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100)
    df = spark.createDataFrame([(i, "u", f"text {i}" * 20) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    archives = warc.write(df, scratch_path(spark, "archives"), min_bytes=10)
    assert archives.count() == 20 and archives.agg({"records": "sum"}).first()[0] == 20
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read(archives).collect()}
    assert got == {f"urn:x-page:{i}": f"text {i}" * 20 for i in range(20)}


def test_small_payloads_are_not_revisits(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id bigint, url string, html string")
    got = warc.read(warc.write(df, scratch_path(spark, "archives"), min_bytes=2)).collect()
    assert sorted((r.record_id[-1], r.record_type) for r in got) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]
