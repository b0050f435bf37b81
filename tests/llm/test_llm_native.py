"""Licences, secrets, lines and mixing beyond what their SQL covers."""

import re
from fractions import Fraction

import odd
import pytest
from pyspark.sql import functions as F

from scatterloom.llm import licenses, lines, mixing, secret_scan

PLAN = r"Python|Pandas|Arrow"


def texts(spark, *found):
    return spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id bigint, text string")


# licences


def test_license_priorities_and_containment(spark):
    cases = {
        "under the Apache License, Version 2.0 only": (8, 1, 2, 2, "apache", "apache,apache-2.0", 1.0),
        # the hint inside the longer name goes, the one outside stays
        "Creative Commons Attribution 4.0; Creative Commons": (7, 0, None, None, "", "cc,cc-by-4.0", 1.0),
        "GNU-General_PUBLIC License (mit license) MIT  License": (8, 3, 0, 6, "gpl,mit", "gpl,mit", 0.8),
        "mit der Zeit, cc-by and ccby": (7, 1, 3, 3, "cc-by", "cc-by", 0.8),
        "nothing here": (2, 0, None, None, "", "", 0.0),
    }
    got = {r.doc_id: tuple(r)[1:] for r in licenses.digest(licenses.scan(texts(spark, *cases))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_license_rules_all_match_what_they_begin_with(spark):
    rules = licenses.rules()
    assert len(rules) > 200
    for r in rules:
        assert all(re.fullmatch(r"[0-9a-z]+", w) for w in r.keywords)
        assert len(re.sub(r"\(\?:([^()]*?)\)\?", r"\1", r.regex).split(" ")) <= licenses.REACH


def expanded(regex, i=0):
    """Texts that a rule's regex matches, by its alternatives and options."""
    out, cur = [], [""]
    while i < len(regex) and regex[i] != ")":
        if regex[i] == "|":
            out, cur, i = out + cur, [""], i + 1
            continue
        if regex.startswith("(?:", i):
            part, i = expanded(regex, i + 3)
        elif regex[i] == "[":
            end = regex.index("]", i)
            part, i = {"[cs]": ["c", "s"], "[0-9]": ["2"], "[0-9a-z]": ["q"]}[regex[i : end + 1]], end
        else:
            part = [regex[i]]
        i += 1
        if many := re.match(r"\?|\+|\{(\d)(,\d)?\}", regex[i:]):
            part = [*part, ""] if many[0] == "?" else [x * int(many[1] or 1) for x in part]
            i += len(many[0])
        cur = [c + x for c in cur for x in part]
    return out + cur, i


def test_every_license_rule_can_be_kept(spark):
    rules = licenses.rules()
    cases = [(n, t) for n, r in enumerate(rules) if not r.base for t in sorted(expanded(r.regex)[0], key=len)[:: max(1, len(expanded(r.regex)[0]) // 6)]]
    got = licenses.scan(spark.createDataFrame(cases, "doc_id bigint, text string")).select("doc_id", "kept.rule").collect()
    assert {n for n, r in enumerate(rules) if not r.base} == {r.doc_id for r in got if r.doc_id in r.rule}


def test_license_notices(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0+",
        "SPDX-License-Identifier: Zlib": "spdx",
        "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0+",
    }
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(texts(spark, *cases))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_license_scan_of_odd_rows(spark):
    df = odd.documents(spark)
    got = licenses.digest(licenses.scan(df)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in odd.plain(df))
    words = {repr(i): len([w for w in re.split(r"[\x00-\x2f:-`{-\x7f]+", re.sub("[A-Z]", "x", t)) if w]) for i, t in odd.plain(df) if i not in (12, None)}
    assert {repr(r.doc_id): r.n_words for r in got if repr(r.doc_id) in words} == words
    assert licenses.scan(odd.empty(spark)).collect() == []


# secrets


def test_trigram_queries_hold_for_every_match():
    sets = secret_scan.trigram_query(r"(?i:api_?key|tok(en|x{2,}y))z")
    assert frozenset(["api", "pik", "ike", "key", "eyz"]) in sets and frozenset(["tok", "oke", "ken", "enz"]) in sets
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == [] and secret_scan.trigram_query(r"abc|x") == []
    assert secret_scan.trigram_query(r"(abcd)?efg") == [frozenset(["efg"])]


def test_secret_spans(spark):
    cases = {
        "é token = \"abcdef1\" x": ["assign:2:18"],
        "secret: token = abcdefgh": [],  # the first match fails and takes its characters along
        "PassWord:'0123456789abcdef01234567'": ["assign:0:34", "hex:10:34"],
        "AKIA" + "A" * 16 + " AKIASHORT": ["access:0:20"],
        "gh" + "p_" + "aZ" * 18 + " https://me:pw@host": ["forge_token:0:40", "url_login:41:55"],
        "🙂bearer  " + "x" * 24: ["bearer:1:33"],
        "-----BEGIN RSA PRIVATE KEY-----": ["private_key:0:31"],
    }
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(texts(spark, *cases))).collect()}
    assert [got[i] for i in range(len(cases))] == [",".join(v) for v in cases.values()]


def test_secrets_without_broadcast_and_odd_rows(spark, monkeypatch):
    df = odd.documents(spark).unionByName(odd.documents(spark).withColumn("text", F.concat(F.lit("api_key=abcdefghij "), F.coalesce("text", F.lit("")))))
    one = odd.collected(secret_scan.digest(secret_scan.scan(df)))
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", -1)
    assert odd.collected(secret_scan.digest(secret_scan.scan(df))) == one
    assert len(one) == df.count() and sum(r[1] for r in one) == df.count() // 2
    assert secret_scan.scan(odd.empty(spark)).collect() == []


# lines


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_dedup(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = line.strip(" ").split(" ")
            if line.strip(" "):
                if any(words == s or min(len(words), len(s)) >= lines.NEAR_WORDS and near(words, s) for s in seen):
                    seen.append(words)
                    continue
                seen.append(words)
            kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


@pytest.mark.parametrize("few", [True, False])
def test_lines_by_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    base = odd.sentence(3, 12).split(" ")
    rows = []
    for i in range(40):
        w = list(base)
        if i % 4 == 1:
            w[i % 12] = f"new{i}"
        if i % 4 == 2:
            w.insert(i % 13, f"more{i}")
        if i % 4 == 3:
            del w[i % 12]
        rows.append((i * 3 % 41, " ".join(w) + "\n\n a b c \nx y\n" + odd.sentence(i, 7) + "\n" + " ".join(reversed(w)) + " \n" + odd.sentence(i % 9, 9 + i % 3)))
    got = {r.doc_id: r.text for r in lines.dedup(texts(spark).union(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == brute_dedup(rows)


def test_lines_whose_hashes_agree_by_chance(spark):
    # the same neighbours in another order: keys of the second kind agree, words don't
    first, other = "a x a y a p q r s t", "z a y a x a p q r s t"
    got = {r.doc_id: r.text for r in lines.dedup(texts(spark, first, other, "a y a x a p q r s t")).collect()}
    assert got == brute_dedup([(0, first), (1, other), (2, "a y a x a p q r s t")])


def test_short_lines_go_when_they_come_again(spark):
    page = "Read more\nhttp://a/b\n\n漢字かな\na\tb\tc\nLes."
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup(texts(spark, page, " Les. \n\nnew\n" + page, "\n")).collect()}
    assert got == {0: (page, 0), 1: ("\nnew\n", 6), 2: ("\n", 0)}


def test_lines_keep_other_columns_and_rows(spark):
    df = odd.documents(spark)
    got = lines.dedup(df)
    assert set(got.columns) == {*df.columns, "n_lines", "n_dropped"} and got.count() == df.count()
    assert lines.dedup(odd.empty(spark)).collect() == []


# mixing


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 3, "b": 5, "c": 11, "d": 1}, {f"s{i}": i % 7 + 1 for i in range(40)}])
def test_less_than_a_block_from_the_target(shares):
    total, done = sum(shares.values()), dict.fromkeys(shares, 0)
    slots = mixing.period_slots(shares)
    assert [s[2] for s in slots] == list(range(total))
    for source, block, slot, release, deadline in slots:
        assert block == done[source] and release <= slot < deadline
        done[source] += 1
        for s, c in shares.items():
            assert abs(done[s] - Fraction(c * (slot + 1), total)) < 1
    assert done == shares


def test_many_sources_keep_their_weights(spark):
    df = spark.range(2001).select(F.concat(F.lit("s"), "id").alias("source"), F.repeat(F.lit("x"), F.when(F.col("id") == 0, 100_000).otherwise(100).cast("int")).alias("text"))
    shares = mixing.shares_by_size(df)
    hot, other = 100_000**0.5, 100**0.5
    total = hot + 2000 * other
    assert len(shares) == 2001
    for s, c in shares.items():
        want = (hot if s == "s0" else other) / total
        assert abs(c / sum(shares.values()) - want) < want / 16
    assert sum(shares.values()) == len(mixing.period_slots(shares))


def test_mixing_odd_rows(spark):
    df = odd.documents(spark)
    shares = {"": 1, "s0": 2, "s1": 3, "s2": 1}
    got = mixing.mix(df, shares, block_chars=100)
    assert got.count() == df.count() and set(got.columns) == {*df.columns, "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_start"}
    for rows in odd_groups(got):
        at = 0
        for r in rows:
            assert r.mix_start == at and r.mix_block == at // 100 and r.mix_release <= r.mix_slot < r.mix_deadline
            at += len(r.text or "")
    assert mixing.mix(odd.empty(spark), shares).collect() == [] and mixing.shares_by_size(odd.empty(spark)) == {}
    with pytest.raises(ValueError):
        mixing.mix(df, {"s0": 0})
    with pytest.raises(Exception, match="no share for source"):
        mixing.mix(df, {"s0": 1}).collect()


def odd_groups(got):
    groups = {}
    for r in got.collect():
        groups.setdefault(r.source or "", []).append(r)
    return [sorted(g, key=lambda r: (r.mix_start, len(r.text or ""))) for g in groups.values()]


def test_native_plans_hold_no_python(spark):
    df = odd.documents(spark).select("doc_id", "text", "source")
    table = spark.createDataFrame([], df.schema)
    for made in (licenses.scan(table), secret_scan.scan(table), lines.dedup(table), mixing.mix(table, {"a": 1})):
        assert not re.search(PLAN, made._jdf.queryExecution().executedPlan().toString())


def test_secrets_in_a_text_with_very_many(spark):
    """A quarter of a million matches in one text, in seconds."""
    import time

    n = 256_000
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('token=abc', lpad(i, 6, '0'))), ' ')").alias("text"))
    start = time.monotonic()
    got = secret_scan.scan(df).select(F.size("spans"), F.col("spans")[n - 1]["start"], F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")).first()
    assert time.monotonic() - start < 60
    assert tuple(got) == (n, (n - 1) * 16, n * 15)
