"""Two tokenizers' alignment against a plain version, character by character."""

import hashlib
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scatterloom.llm import align_tokens, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def tokens(coders, text):
    """(id, bytes) of both; none where they don't give the text back."""
    a, b = coders
    letters = align_tokens.byte_letters()
    xs = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    ys = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        ys.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (xs, ys) if text and all(b"".join(w for _, w in side) == whole for side in (xs, ys)) else ([], [])


def plain_groups(xs, ys):
    out, i, j = [], 0, 0
    while i < len(xs):
        ga, gb, na, nb = [], [], 0, 0
        while not ga or na != nb:
            if na <= nb:
                ga.append(xs[i][0])
                na += len(xs[i][1])
                i += 1
            else:
                gb.append(ys[j][0])
                nb += len(ys[j][1])
                j += 1
        out.append((ga, gb))
    return out


def plain(coders, rows):
    docs = [(i, plain_groups(*tokens(coders, t or ""))) for i, t in rows]
    links = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for _, groups in docs]
    count = Counter(p for c in links for p in c)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, groups), c in zip(docs, links, strict=True):
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            i, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), c.total(), sum(n for p, n in c.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(told.encode()).hexdigest() if told else "",
        ))
    return sorted(out, key=repr)


def made(df, **how):
    alignment = align_tokens.align(df, *FILES, **how)
    rows = align_tokens.scored(alignment, align_tokens.pair_counts(alignment))
    return odd.collected(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_given_documents(spark, sf, coders):
    got = odd.collected(queries.op12_token_alignment(spark, sf))
    assert got == plain(coders, odd.plain(spark.read.parquet(f"{sf}/documents.parquet")))


@pytest.mark.parametrize("how", [{}, {"chunk_pairs": 1}])
def test_odd_rows(spark, coders, how):
    more = ["<|endoftext|> <s> </s> <unk> <0x41>", "漢字かなカナ" * 40, "two  spaces\n\nand\tmore ", "▁ is changed", "a" * 500 + " " * 500, "ﬁ Å é é", "\x00", "🙂" * 50]
    df = odd.documents(spark).select("doc_id", "text", "id", "n").unionByName(spark.createDataFrame([(100 + i, t, None, 1) for i, t in enumerate(more)], "doc_id bigint, text string, id bigint, n int"))
    got = made(df, **how)
    assert got == plain(coders, [(r.doc_id, r.text) for r in df.collect()])
    assert {r[0]: r[1] for r in got}[103] == 0  # a letter that stands for a space inside the model


def test_empty_table(spark):
    assert made(odd.empty(spark)) == []


def test_overlaps_are_all_pairs_that_share_a_byte(coders):
    texts = ["unbelievably antidisestablishmentarian 漢字 words", "", "straße 12345678"]
    c = align_tokens.Coders(*FILES)
    a, b = c.sides(texts)
    x, y = align_tokens.overlaps(a, b)
    want = [(i, j) for i in range(len(a.ids)) for j in range(len(b.ids)) if a.start[i] < b.stop[j] and b.start[j] < a.stop[i]]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_wide_groups_count_like_narrow_ones(coders, monkeypatch):
    texts = ["漢字🙂 é" * 30 + " some plain words as well"]
    c = align_tokens.Coders(*FILES)
    want = [np.array(v).tolist() for v in align_tokens.aligned(c, texts)[1:]]
    for name, value in (("WIDE", 0), ("STEP", 2)):
        monkeypatch.setattr(align_tokens, name, value)
        assert [np.array(v).tolist() for v in align_tokens.aligned(c, texts)[1:]] == want


def test_very_long_runs(coders):
    c = align_tokens.Coders(*FILES)
    for text in ("a" * 300_000, " " * 300_000, "\n" * 300_000):
        told = align_tokens.aligned(c, [text])[0]
        assert told["n_a"][0] and told["n_groups"][0]
