import bisect
import hashlib
import re
import struct

import odd
import pytest
import xxhash

from scatterloom.llm import ordermin


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v, seed=h).intdigest()
    return signed(h)


def fingerprint(text):
    words = [w for w in re.split(r"[\x00-\x20]+", text) if w]
    words = [u for w in words for u in (w if len(w) > ordermin.LONG else [w])]
    if not words:
        return ""
    seen, found = {}, []
    for i in range(max(1, len(words) - ordermin.K + 1)):
        h = chained(*(w.encode() for w in words[i : i + ordermin.K])) >> ordermin.PLACE_BITS
        n = seen[h] = seen.get(h, -1) + 1
        found.append((chained(struct.pack("<q", h), struct.pack("<i", n)) >> ordermin.PLACE_BITS if n else h, i))
    out = []
    for e in range(ordermin.ENTRIES):
        order = [(chained(struct.pack("<q", h), struct.pack("<i", e)) >> ordermin.PLACE_BITS, i) for h, i in found]
        two = sorted((min(order), max(order)), key=lambda p: p[1])
        out.append("%08X" % (chained(*(struct.pack("<q", h) for h, _ in two)) >> 32 & 0xFFFFFFFF))
    return "".join(out)


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / ordermin.ENTRIES


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(fingerprint, (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("rows", [1000, 2])
def test_same_as_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(ordermin, "BLOCK_ROWS", rows)
    df = odd.documents(spark)
    assert odd.collected(ordermin.compare(df)) == sorted(brute(odd.plain(df)), key=repr)


def test_given_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = odd.collected(ordermin.compare(df))
    assert got == sorted(brute(odd.plain(df)), key=repr)
    assert sum(r[5] for r in got) > 20 * sum(r[6] for r in got)


def test_one_row_and_none(spark):
    df = odd.documents(spark)
    one = df.where("doc_id = 1")
    assert odd.collected(ordermin.compare(one)) == brute(odd.plain(one))
    assert ordermin.compare(odd.empty(spark)).collect() == []


def test_order_matters(spark):
    words = [f"w{i}" for i in range(200)]
    turned = " ".join(words[100:] + words[:100])
    df = spark.createDataFrame([(1, " ".join(words)), (2, turned), (3, " ".join(words[:-1]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ordermin.compare(df).collect()}
    # the same k-mers but for two: a set would hardly tell them apart, pairs in order do
    assert likeness(got[1].fingerprint, got[2].fingerprint) < 0.7 < 0.9 < likeness(got[1].fingerprint, got[3].fingerprint)


def test_texts_without_spaces(spark):
    ideographs = "".join(chr(0x4E00 + i * i % 5003) for i in range(1400))
    far = "".join(chr(0x6E00 + i * i % 5003) for i in range(1400))
    rows = [(1, ideographs), (2, ideographs + "\u9fff"), (3, far), (4, "x" * 49), (5, "x" * 48), (6, "\U0001f642e\u0301" * 40)]
    got = odd.collected(ordermin.compare(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == sorted(brute(rows), key=repr)
    assert got[0][6] > 0.9 and got[1][6] < 0.1


def test_entries_are_independent_draws(spark):
    """Shares of equal entries follow the share of common pairs with the spread of ENTRIES independent draws, for short texts, too."""
    rows = []
    for t in range(300):
        words = [f"t{t}w{i}" for i in range(42)]
        other = [*words[:33], *(f"t{t}v{i}" for i in range(9))]
        rows += [(2 * t, " ".join(words)), (2 * t + 1, " ".join(other))]
    common, union = 31, 49  # of 40 k-mers each
    p = common * (common - 1) / (union * (union - 1))
    got = {r.doc_id: r.near_next for r in ordermin.compare(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near = [got[2 * t] for t in range(300)]
    mean = sum(near) / 300
    spread = (sum((x - mean) ** 2 for x in near) / 299) ** 0.5
    draws = (p * (1 - p) / ordermin.ENTRIES) ** 0.5
    assert abs(mean - p) < 4 * draws / 300**0.5
    assert 0.85 * draws < spread < 1.15 * draws
