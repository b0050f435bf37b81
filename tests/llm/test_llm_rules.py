"""Statistics against a plain version, rules against exhaustive search, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from scatterloom.llm import queries, rules


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_given_documents(spark, sf):
    got = queries.op13_quality_rules(spark, sf).select("doc_id", *NAMES, "kept").collect()
    docs = dict(odd.plain(spark.read.parquet(f"{sf}/documents.parquet")))
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: plain(t) for i, t in docs.items()} and len(got) == len(docs)
    assert not any(r.kept and r.base_failed for r in got)


def test_held_out_accuracy(spark):
    """Of rows whose labels were not learned from and that the fixed rules leave."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op13_quality_rules(spark, sf).where("held_out and not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n, right, good, kept_good = rows.select(F.count("*"), F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.sum("quality"), F.sum(F.col("kept").cast("int") * F.col("quality"))).first()
    assert n > 1000 and right >= 0.98 * n and kept_good >= 0.99 * good


def test_odd_rows(spark):
    df = odd.documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(200, "a b c d e a b c d e a"), (201, "x " * 30), (202, "a b c\x0bd\x0ce\x1cf\n\n\na b c\x0bd\x0ce\x1cf"), (203, "| <a> | $5 100% #tag *")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None), (12, 0), (12, 1), (999, 1)], "doc_id bigint, quality int")
    got = rules.judge(df.withColumn("x", F.lit(1)), labels).select("doc_id", *NAMES)
    assert odd.collected(got) == sorted(((i, *plain(t)) for i, t in odd.plain(df)), key=repr)


def test_empty_tables(spark, sf):
    docs, labels = odd.empty(spark), spark.read.parquet(f"{sf}/labels.parquet")
    assert rules.judge(docs, labels).collect() == []
    rows = rules.judge(odd.documents(spark), labels.limit(0)).collect()
    assert len(rows) == odd.documents(spark).count() and all(r.kept != r.base_failed for r in rows)


def test_steps_don_t_matter(monkeypatch):
    texts = ["", "one two\none two", odd.sentence(3, 80), "tail tail tail tail tail tail tail", " \n "]
    want = rules.count(texts)
    monkeypatch.setattr(rules, "STEP", 1)
    assert rules.count(texts).equals(want)


def table(rows):
    x = {"a": np.array([r[0] for r in rows], float), "b": np.array([r[1] for r in rows], float)}
    return x, np.array([r[2] for r in rows])


def test_first_condition_is_the_best_of_all():
    draw = np.random.default_rng(5)
    x = {"a": draw.integers(0, 9, 60).astype(float), "b": draw.random(60)}
    y = ((x["a"] < 4) ^ (draw.random(60) < 0.2)).astype(int)
    said = rules.grow(x, y, 0).conditions[0]

    def gain(c):
        hit = c.holds(x)
        p, n, p0, n0 = (y[hit] == 0).sum(), (y[hit] == 1).sum(), (y == 0).sum(), (y == 1).sum()
        return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0

    every = [rules.Condition(k, s, float(c)) for k in x for s in (True, False) for c in rules.cuts_of(x[k])]
    assert gain(said) == pytest.approx(max(map(gain, every)))


def test_covering_finds_conjunctions_and_leaves_noise():
    draw = np.random.default_rng(3)
    rows = [(a, b, 0 if (a > 0.7 and b > 0.6) or a < 0.1 else 1) for a, b in draw.random((1500, 2))]
    x, y = table(rows)
    found = rules.cover(x, y)
    assert 2 <= len(found.rules) <= 8 and (found.decide(x) == y).mean() > 0.97
    noise = rules.cover(x, draw.integers(0, 2, len(y)), precision=0.9)
    assert (noise.decide(x) == 1).mean() > 0.9
    assert rules.cover({k: v[:0] for k, v in x.items()}, y[:0]).rules == ()


def test_pruning_drops_conditions_that_don_t_help():
    x, y = table([(a, b, int(a < 5)) for a in range(10) for b in range(4)])
    long = rules.Rule((rules.Condition("b", True, 2.0), rules.Condition("a", True, 5.0)), 0)
    assert rules.prune(long, x, y).conditions == (rules.Condition("a", True, 5.0),)


def test_expression_follows_the_order_of_rules(spark):
    one = rules.DecisionList((rules.Rule((rules.Condition("words", True, 3.0), rules.Condition("line_words", False, 2.0)), 0), rules.Rule((rules.Condition("words", True, 3.0),), 1)), 0)
    x = {"words": np.array([1.0, 3, 5, 4]), "line_words": np.array([0.0, 1, 2, 3])}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], list(x))
    assert [r[0] for r in df.select(one.column()).collect()] == one.decide(x).tolist() == [0, 0, 1, 1]
    assert str(one).split("\n") == ["if words >= 3 and line_words < 2 then 0", "if words >= 3 then 1", "else 0"]
