"""Each stage of the pipeline against a plain version, on what the stages before it kept."""

import hashlib

import odd
import public_tokenizers
import pytest
import tiktoken
from test_llm_minhash import brute as brute_groups
from test_llm_native import brute_dedup

import corpus_pipeline as pipeline
from scatterloom.llm import bpe, mixing, quality
from scatterloom.scratch import write_and_reread


@pytest.fixture(scope="module")
def staged(spark, sf):
    """What each stage got and made."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = write_and_reread(stage(spark, docs, sf), name)
        out[name] = docs, made
        docs = made
    return out


def by_id(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages_keep_the_columns(staged):
    for name in [n for n, _ in pipeline.STAGES][:-1]:
        assert staged[name][1].columns == staged["quality"][0].columns


def test_quality(spark, sf, staged):
    got, made = map(by_id, staged["quality"])
    scores = quality.classify(staged["quality"][0], spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert made == {i: got[i] for i in (r.doc_id for r in scores if r.predicted)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [i for i in got if i in labels]
    assert sum((i in made) == labels[i] for i in known) >= 0.9 * len(known)


def test_line_dedup(staged):
    got, made = map(by_id, staged["line_dedup"])
    want = {}
    for i, text in brute_dedup([(i, r["text"] or "") for i, r in got.items()]).items():
        left = any(x.strip(" ") for x in text.split("\n"))
        if text == (got[i]["text"] or ""):
            want[i] = got[i]
        elif left:
            want[i] = got[i] | {"text": text, "n_chars": len(text)}
    assert made == want


def test_documents_with_short_lines_left_stay(spark, sf):
    notice = "this site uses cookies to serve you well"
    docs = spark.createDataFrame([(1, notice, 40), (2, f"漢字かな\n{notice}\na\tb", 99), (3, f"{notice}\n漢字かな\n", 99), (4, "", 0)], "doc_id bigint, text string, n_chars bigint")
    assert by_id(pipeline.without_repeated_lines(spark, docs, sf)) == by_id(spark.createDataFrame([(1, notice, 40), (2, "漢字かな\na\tb", 8), (4, "", 0)], docs.schema))


def test_near_dedup(staged):
    got, made = map(by_id, staged["near_dedup"])
    groups = brute_groups([(i, r["text"] or "") for i, r in got.items()], 5, 80)
    assert made == {i: r for i, r in got.items() if groups[i][1] == i}


def test_mixing_keeps_rows_and_orders_them(staged):
    got, made = staged["mixing"]
    assert by_id(got) == by_id(made)
    order = {r.doc_id: (r.mix_slot, r.mix_start, r.doc_id) for r in mixing.mix(got, mixing.shares_by_size(got)).collect()}
    parts = made.rdd.glom().map(lambda rows: [r.doc_id for r in rows]).collect()
    ranges = sorted([order[i] for i in p] for p in parts if p)
    assert all(p == sorted(p) for p in ranges) and all(a[-1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_rows_of_run_come_in_mixed_order(spark, sf, monkeypatch):
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[3:])
    got = spark.read.parquet(f"{sf}/documents.parquet")
    order = sorted((r.mix_slot, r.mix_start, r.doc_id) for r in mixing.mix(got, mixing.shares_by_size(got)).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files, also of little data
    try:
        assert [r.doc_id for r in pipeline.run(spark, sf).collect()] == [i for _, _, i in order]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_encoding(staged):
    got, made = map(by_id, staged["encode"])
    ranks = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, r in got.items():
        ids = library.encode_ordinary(r["text"])
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(data).hexdigest(), "decoded_sha256": hashlib.sha256(r["text"].encode()).hexdigest()}
    place = {i: [r.pop(c) for c in pipeline.PLACE] for i, r in made.items()}
    assert made == want
    order = {r.doc_id: (r.mix_slot, r.mix_start, r.doc_id) for r in mixing.mix(staged["mixing"][0], mixing.shares_by_size(staged["mixing"][0])).collect()}
    assert sorted(place, key=place.get) == sorted(order, key=order.get)


def test_leaving_mixing_out_changes_the_result(spark, sf, monkeypatch):
    both = []
    for stages in (pipeline.STAGES[3:], pipeline.STAGES[4:]):
        monkeypatch.setattr(pipeline, "STAGES", stages)
        both.append([r.doc_id for r in pipeline.run(spark, sf).collect()])
    assert sorted(both[0]) == sorted(both[1]) and both[0] != both[1]


def test_near_dedup_of_repeated_ids(spark, sf):
    a, b, c = (odd.sentence(k, 30) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (1, a), (2, c), (2, c), (3, c), (4, a), (None, a), (None, a), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in pipeline.without_near_duplicates(spark, docs, sf).collect()]
    # documents 1 are two texts, so both stay; 2 is 3's smaller id
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == sorted([(1, a), (1, b), (2, c)])
    assert got.count((None, a)) == 2 and got.count((5, None)) == 1 and got.count((6, "")) == 1


def test_stages_bear_odd_rows(spark, sf):
    docs = odd.documents(spark)
    known = {repr(i) for i, _ in odd.plain(docs)}
    for name, stage in pipeline.STAGES:
        for rows in (odd.empty(spark), docs):
            made = stage(spark, rows, sf)
            if name != "encode":
                assert made.columns == rows.columns
            found = made.collect()
            assert {repr(r.doc_id) for r in found} <= known and (len(found) > 0) == (rows is docs)


def test_run_is_registered(spark, sf, staged):
    import __spark_entry__ as contract

    assert odd.collected(contract.queries()["pipeline"](spark, sf).drop(*pipeline.PLACE)) == odd.collected(staged["encode"][1].drop(*pipeline.PLACE))
    assert [n for n in contract.queries() if n.startswith("op")] == ["op1_quality", "op2_licenses", "op3_topk", "op4_near_dedup", "op5_byte_bpe", "op6_fingerprints", "op7_line_dedup", "op8_mixing", "op9_secrets", "op10_warc", "op11_merkle", "op12_token_alignment", "op13_quality_rules"]
