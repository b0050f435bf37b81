import hashlib
import random

import odd
import public_tokenizers
import pytest
import tiktoken

from scatterloom.llm import bpe

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codecs():
    own = bpe.Codec(FILE, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_the_library(codecs):
    own, library = codecs
    draw = random.Random(3)
    letters = " \n\t\r\x0b\x1c\x1d\x85\xa0 　aäßЖ漢字🙂١٢a1'stllve.,-_\x00​é﻿"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "a", "a" * 5000, "ab" * 3000, "thethe" * 900, "".join(draw.choice("abc") for _ in range(8000)), "<|endoftext|> x"]
    for text in texts:
        ids = own.encode(text)
        assert list(ids) == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_cache_turns_over(codecs, monkeypatch):
    own, library = codecs
    monkeypatch.setattr(bpe, "CACHE", 10)
    text = odd.sentence(5, 400)
    assert list(own.encode(text)) == library.encode_ordinary(text)
    assert len(own.young) <= 10


def test_digests_of_odd_rows(spark, codecs):
    _, library = codecs
    df = odd.documents(spark)
    want = []
    for doc_id, text in odd.plain(df):
        ids = library.encode_ordinary(text)
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert odd.collected(bpe.digests(df, FILE, PATTERN)) == sorted(want, key=repr)
    assert bpe.digests(odd.empty(spark), FILE, PATTERN).collect() == []


def test_round_trip_of_tables(spark):
    df = odd.documents(spark)
    back = bpe.decode(bpe.encode(df, FILE, PATTERN), FILE, PATTERN)
    assert odd.collected(back) == sorted(((i, bytearray(t.encode())) for i, t in odd.plain(df)), key=repr)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), FILE, PATTERN).collect()[0].data == b""
