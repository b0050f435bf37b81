"""Two tokenizers side by side: which tokens of one cover which of the other, and how often ids meet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import kept, whole_text

#: Bytes of text that are aligned at once, and token pairs that a chunk of documents is closed at; both are passed by a longer text only.
BATCH_BYTES, CHUNK_PAIRS = 1 << 20, 1 << 21
#: A pair of ids in one number: first * SHIFT + second.
SHIFT = 1 << 31
#: Groups with more pairs than this are counted by their distinct ids first.
WIDE = 64
#: Pairs of ids that are looked at in one step.
STEP = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encodes by a byte-level vocabulary of the tokenizers library; ``tokens`` holds each id's bytes.

    Ranks are the ids of that file, and the merges are done by tiktoken, which finds the same ids several times faster.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["id"] for t in told["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in told["model"]["vocab"].items() if i not in special}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.tokens[i] = word
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError(f"{path} has no token for some bytes")
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text with a space before it. With a token for every byte, as here, they always give the bytes back."""
        return [self.encoding.encode_ordinary(" " + t) if t else [] for t in texts]


class Pieces:
    """Encodes by a sentencepiece model, which puts a space before each text; ``tokens`` holds each id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text; none for one that they don't give back byte by byte."""
        found = self.model.encode(list(texts), num_threads=1)
        return [ids if t and b"".join(map(self.tokens.__getitem__, ids)) == b" " + t.encode() else [] for t, ids in zip(texts, found, strict=True)]


class Side:
    """One tokenizer's tokens of a batch of documents: ``ids``, ``doc`` and byte ranges from the batch's start on."""

    def __init__(self, coder: Any, found: Sequence[Sequence[int]]) -> None:
        sizes = np.array([len(x) for x in coder.tokens])
        self.n = np.array([len(x) for x in found], np.int64)
        self.ids = np.fromiter(chain.from_iterable(found), np.int64, int(self.n.sum()))
        self.doc = np.repeat(np.arange(len(found)), self.n)
        self.stop = np.cumsum(sizes[self.ids])
        self.start = self.stop - sizes[self.ids]


def covering(side: Side, other: Side) -> np.ndarray:
    """For each token of ``side`` the token of ``other`` that covers its first byte."""
    left = pd.DataFrame({"at": side.start, "doc": side.doc})
    right = pd.DataFrame({"at": other.start, "doc": other.doc, "token": np.arange(len(other.ids))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy()


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a byte, in order: of two such tokens one holds the other's first byte, so both directions together have each pair."""
    forth, back = covering(a, b), covering(b, a)
    x = np.concatenate((np.arange(len(a.ids)), back))
    y = np.concatenate((forth, np.arange(len(b.ids))))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def groups(a: Side, b: Side, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of both sides, and how many groups there are: overlapping tokens that end together close a group."""
    together = a.stop[x] == b.stop[y]
    of = []
    for side, at in ((a, x), (b, y)):
        last = np.zeros(len(side.ids), np.int64)
        last[at[together]] = 1
        of.append(np.cumsum(last) - last)
    return of[0], of[1], int(together.sum())


def pairs_of(a: Side, b: Side, ga: np.ndarray, gb: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, pair, times``: ids that share a group, with the number of their links there; a pair comes once for each group or oftener."""
    na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    doc = a.doc[sa] if n_groups else np.zeros(0, np.int64)
    wide = na * nb > WIDE
    narrow = np.flatnonzero(~wide)
    size = na[narrow] * nb[narrow]
    cut = np.searchsorted(np.cumsum(size), np.arange(STEP, int(size.sum()) + STEP, STEP), "left") + 1
    for part in np.split(narrow, np.minimum(cut, len(narrow))):
        if not len(part):
            continue
        count = na[part] * nb[part]
        g = np.repeat(part, count)
        at = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
        yield doc[g], a.ids[sa[g] + at // nb[g]] * SHIFT + b.ids[sb[g] + at % nb[g]], np.ones(len(g), np.int64)
    for g in np.flatnonzero(wide):
        ua, ca = np.unique(a.ids[sa[g] : sa[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b.ids[sb[g] : sb[g] + nb[g]], return_counts=True)
        rows = max(1, STEP // len(ub))
        for lo in range(0, len(ua), rows):
            pair = (ua[lo : lo + rows, None] * SHIFT + ub).ravel()
            yield np.full(len(pair), doc[g]), pair, (ca[lo : lo + rows, None] * cb).ravel()


def written(a: Side, b: Side, ga: np.ndarray, gb: np.ndarray, n_docs: int) -> list[str]:
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    key = np.concatenate((ga * 2, gb * 2 + 1))
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate((a.ids, b.ids))[order]
    doc = np.concatenate((a.doc, b.doc))[order]
    # what follows a token: a comma within a side, a bar after the first one, a semicolon after the group, nothing after the document
    sign = np.zeros(len(ids), np.int64)
    sign[:-1] = np.where(key[1:] == key[:-1], 0, 1 + key[:-1] % 2)
    ends = np.searchsorted(doc, np.arange(n_docs), "right")
    sign[ends[ends > 0] - 1] = 3
    words = kept_words(int(ids.max(initial=0)))
    parts = words[sign, ids].tolist()
    return ["".join(parts[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


_words: list[np.ndarray] = [np.zeros((4, 0), object)]


def kept_words(highest: int) -> np.ndarray:
    """Decimal ids up to ``highest`` followed by each sign; vocabularies bound the table."""
    if highest >= _words[0].shape[1]:
        _words[0] = np.array([[f"{i}{s}" for i in range(highest + 1)] for s in (",", "|", ";", "")], object)
    return _words[0]


class Coders:
    """Both tokenizers, as a worker keeps them."""

    def __init__(self, byte_level: str, pattern: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level, pattern), Pieces(pieces)

    def sides(self, texts: Sequence[str]) -> tuple[Side, Side]:
        """The tokens of both; none for an empty text and for one that either tokenizer doesn't give back byte by byte with a space before it."""
        found_b = self.b.encode(texts)
        found_a = self.a.encode([t if f else "" for t, f in zip(texts, found_b, strict=True)])
        return Side(self.a, found_a), Side(self.b, found_b)


def batches_of(texts: Sequence[str], limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(text)
    if len(texts) > lo:
        yield slice(lo, len(texts))


COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, values)
    return out


def aligned(coders: Coders, texts: Sequence[str]) -> tuple[dict[str, Any], np.ndarray, np.ndarray, np.ndarray]:
    """What `COUNTS` names, for each text, and ``doc, pair, times`` with each pair of ids once for a document."""
    a, b = coders.sides(texts)
    ga, gb, n_groups = groups(a, b, *overlaps(a, b))
    na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    doc = np.zeros(n_groups, np.int64)
    doc[ga] = a.doc
    told = {
        "n_a": a.n, "n_b": b.n, "n_groups": np.bincount(doc, minlength=len(texts)), "n_links": _sums(doc, na * nb, len(texts)),
        "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in written(a, b, ga, gb, len(texts))],
    }
    d = p = t = np.zeros(0, np.int64)
    for more in pairs_of(a, b, ga, gb, n_groups):
        d, p, t = merged(*(np.concatenate(x) for x in zip((d, p, t), more, strict=True)))
    return told, d, p, t


def merged(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal ``doc, pair`` made one, ``times`` added up; in order."""
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], pair[first], np.add.reduceat(times[order], first) if len(first) else times


def align(df: DataFrame, byte_level: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """``id_col``, ``chunk``, the counts of `COUNTS`, and the document's pairs of ids as ``at`` (places in its chunk's list) and ``times``; and a row for
    each chunk of documents with its list: ``pairs`` and ``docs``, the number of its documents that hold each. Written to the scratch folder.

    ``byte_level`` and ``pieces`` are the files of the two tokenizers, which every executor must be able to open. A null text counts as
    empty; empty texts, and texts that one of the tokenizers doesn't give back, have no tokens. Rows that repeat count as often as they come.
    Memory grows with the longest text, and with the pairs of ids of a chunk.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"chunk bigint, id {id_type}, {COUNTS}, at array<int>, times array<bigint>, pairs array<bigint>, docs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = kept((byte_level, pattern, pieces), lambda: Coders(byte_level, pattern, pieces))
        part, n_chunks = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []  # ids, counts, doc, pair, times of batches of the open chunk
        held = 0
        kinds = None

        def close() -> Iterator[pa.RecordBatch]:
            pairs, docs = np.unique(np.concatenate([r[3] for r in rows]), return_counts=True)
            none = lambda n, kind: pa.nulls(n, kind)
            for ids, told, doc, pair, times in rows:
                n = len(ids)
                stops = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(stops, pa.array(v, k)) for v, k in ((np.searchsorted(pairs, pair), pa.int32()), (times, pa.int64()))]
                counts = [pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in told.items()]
                columns = [pa.array(np.full(n, part + n_chunks)), ids, *counts, *lists, none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)
            last = [pa.ListArray.from_arrays(np.array([0, len(v)], np.int32), pa.array(v, k)) for v, k in ((pairs, pa.int64()), (docs, pa.int32()))]
            empty = [none(1, pa.string() if k == "groups_sha256" else pa.int64()) for k in rows[0][1]]
            yield pa.RecordBatch.from_arrays([pa.array([part + n_chunks]), none(1, kinds), *empty, none(1, pa.list_(pa.int32())), none(1, pa.list_(pa.int64())), *last], names)

        for batch in batches:
            kinds = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for s in batches_of(texts):
                told, doc, pair, times = aligned(coders, texts[s])
                rows.append((batch.column(0).slice(s.start, s.stop - s.start), told, doc, pair, times))
                held += len(pair)
                if held >= chunk_pairs:
                    yield from close()
                    rows.clear()
                    held, n_chunks = 0, n_chunks + 1
        if rows:
            yield from close()

    names = ["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "docs"]
    rows = df.select(df[id_col].alias("id"), whole_text(df, text_col).alias("text"))
    return write_and_reread(rows.mapInArrow(run, schema), "aligned").withColumnRenamed("id", id_col)


def _of_chunks(df: DataFrame, id_col: str) -> DataFrame:
    return df.where("pairs is null").select(*(c for c in df.columns if c not in ("pairs", "docs")))


def pair_counts(alignment: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many documents hold each pair of ids linked, and whether no other pair of ``a`` is held by more."""
    pairs = alignment.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    counts = counts.select(F.expr(f"pair div {SHIFT}").alias("a"), F.expr(f"pair % {SHIFT}").alias("b"), "count")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(alignment: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the counts of `COUNTS`, ``n_best`` and ``count_sum`` of every document.

    The counts go to the chunks that hold the pair and meet there the chunk's documents, so what is joined is a row for each pair of a chunk and not of a document.
    """
    counts = counts.select((F.col("a") * SHIFT + F.col("b")).alias("pair"), "count", "best")
    held = alignment.where("pairs is not null").select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("place", "pair"))
    known = held.join(counts, "pair").select("of_chunk", "place", F.when(F.col("best"), F.col("count")).otherwise(-F.col("count")).alias("signed"))
    docs = _of_chunks(alignment, id_col).withColumnRenamed(id_col, "id")
    keep = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join([f"id {docs.schema['id'].dataType.simpleString()}", COUNTS, "n_best bigint", "count_sum bigint"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        signed = np.zeros(right.num_rows, np.int64)
        signed[right.column("place").to_numpy()] = right.column("signed").to_numpy()
        at, times = (left.column(c).combine_chunks() for c in ("at", "times"))
        doc = np.repeat(np.arange(left.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
        count, many = signed[at.flatten().to_numpy()], times.flatten().to_numpy()
        made = [_sums(doc, v, left.num_rows) for v in (np.where(count > 0, many, 0), np.abs(count) * many)]
        return pa.Table.from_arrays([*(left.column(c) for c in keep), *map(pa.array, made)], [*keep, "n_best", "count_sum"])

    met = docs.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(meet, schema)
    return met.withColumnRenamed("id", id_col)
