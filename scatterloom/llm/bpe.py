"""Byte-level BPE by a rank queue over a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts

#: Pre-tokens kept per generation of a worker's cache; two generations are alive.
CACHE = 400_000
#: Ranks of pairs kept by a worker.
PAIRS = 500_000


class Pairs(dict):
    """Ranks of pairs of ids, -1 for those that don't merge; looked up in the vocabulary when first asked for."""

    def __init__(self, words: list[bytes], ranks: dict[bytes, int]):
        super().__init__()
        self.words, self.ranks = words, ranks

    def __missing__(self, pair: tuple[int, int]) -> int:
        if len(self) >= PAIRS:
            self.clear()
        rank = self[pair] = self.ranks.get(self.words[pair[0]] + self.words[pair[1]], -1)
        return rank


class Codec:
    """Encodes and decodes texts by a rank file; ``pattern`` splits a text into pieces first."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.letters = np.frombuffer(b"".join(words), np.uint8)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = Pairs(words, self.ranks)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: the pair of the lowest rank merges first, of equal ones the first.

        The queue holds positions by the rank of the pair that starts there. A bucket per rank heads a
        linked list of positions. Bitmaps of 256 bits (``leaves``) tell which buckets hold any, a bitmap
        above (``top``) which of the leaves do, so two find-first-set steps give the next rank. A merge
        leaves queued positions behind whose pair has changed: they are skipped when they come up.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        pairs, byte_ids = self.pairs, self.byte_ids
        ids = [byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        heads: dict[int, tuple] = {}
        leaves: dict[int, int] = {}
        top = 0
        pair = [-1] * n  # rank of the pair that starts at i; a queued position with another rank is stale
        i = n - 1
        while i:  # backwards: lists then begin with the first position
            i -= 1
            rank = pairs[ids[i], ids[i + 1]]
            if rank >= 0:
                pair[i] = rank
                head = heads.get(rank)
                if head is None:
                    leaf = rank >> 8
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & 255)
                    top |= 1 << leaf
                heads[rank] = i, head
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            bits ^= low
            leaves[leaf] = bits
            if not bits:
                top &= top - 1
            rank = leaf << 8 | low.bit_length() - 1
            i, rest = heads.pop(rank)
            if rest is None:
                places = (i,)
            else:
                places = [i]
                while rest is not None:
                    i, rest = rest
                    places.append(i)
                places.sort()
            for at, i in enumerate(places):
                if pair[i] != rank:
                    continue
                right = after[i]
                over = after[right]
                ids[i] = rank
                ids[right] = pair[right] = pair[i] = -1
                after[i] = over
                grown = []
                if over < n:
                    before[over] = i
                    new = pairs[rank, ids[over]]
                    if new >= 0:
                        pair[i] = new
                        grown.append((new, i))
                back = before[i]
                if back >= 0:
                    pair[back] = new = pairs[ids[back], rank]
                    if new >= 0:
                        grown.append((new, back))
                lower = False
                for new, place in grown:
                    lower = lower or new < rank
                    head = heads.get(new)
                    if head is None:
                        leaf = new >> 8
                        leaves[leaf] = leaves.get(leaf, 0) | 1 << (new & 255)
                        top |= 1 << leaf
                    heads[new] = place, head
                if lower and at + 1 < len(places):  # a pair that goes first came up: the rest of the bucket waits
                    head = heads.get(rank)
                    for place in reversed(places[at + 1 :]):
                        head = place, head
                    heads[rank] = head
                    leaf = rank >> 8
                    leaves[leaf] |= 1 << (rank & 255)
                    top |= 1 << leaf
                    break
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> np.ndarray:
        young, old, out = self.young, self.old, []
        for word in self.split(text):
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = np.array(self.piece(word.encode()), "<u4").tobytes()
                if len(young) >= CACHE:
                    self.old = old = young
                    self.young = young = {}
                if len(word) <= 64:
                    young[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        out, step = [], 1 << 20
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step].astype(np.int64)
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            if not len(ends) or not ends[-1]:
                continue
            at = np.repeat(self.starts[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            out.append(self.letters[at].tobytes())
        return b"".join(out)


def codec(rank_file: str, pattern: str) -> Codec:
    """A codec, built once per worker."""
    return kept((rank_file, pattern), lambda: Codec(rank_file, pattern))


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row's whole text. A null or empty text has no ids.

    ``rank_file`` is a path that every executor can open. Rows are independent: those whose id is null
    or repeat come back as they are, other columns are left out. There is no shuffle.
    """

    def run(texts: list[str]) -> list[list]:
        c = codec(rank_file, pattern)
        return [[c.encode(t).astype(np.int32) for t in texts]]

    return map_texts(df, id_col, text_col, {"ids": "array<int>"}, run)


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``data`` (binary) of each row's ids; null ids give no bytes, ids outside the vocabulary raise."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[ids_col], F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            data = [c.decode(np.array(i, np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return rows.mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``n_tokens``, ``ids_sha256`` of the ids as little-endian 32-bit numbers and ``decoded_sha256`` of the bytes decoded from them.

    Encodes and decodes in one pass, so ids don't leave the worker. Nulls and repeats as in `encode`.
    """

    def run(texts: list[str]) -> list[list]:
        c = codec(rank_file, pattern)
        lengths, ids_sha, decoded_sha = [], [], []
        for text in texts:
            ids = c.encode(text)
            lengths.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [lengths, ids_sha, decoded_sha]

    return map_texts(df, id_col, text_col, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, run)
