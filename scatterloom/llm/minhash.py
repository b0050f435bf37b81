"""Near-duplicate documents: circulant MinHash, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import kept, map_texts, partitions, whole_text
from .components import components

#: Bands of a signature and coordinates of a band. A pair at 0.8 is missed by all bands with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Rows of a bucket that meet in one task: larger buckets are cut, and every cut meets every other one.
CELL = 512
#: How far the share of equal coordinates may fall below the wanted similarity before a pair of a bucket isn't verified: over five standard deviations.
MARGIN = 0.17
#: Documents to verify whose ids are broadcast at most; beyond, texts are picked by a shuffle.
BROADCAST_ROWS = 200_000

#: Hashes of words kept by a worker.
WORDS = 500_000


def word_list(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; characters U+0020 and U+0009 to U+000D lie between them."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of k words, ascending; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    known, digest = kept("word hashes", dict), xxhash.xxh3_64_intdigest
    if len(known) > WORDS:
        known.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            x = known[w] = digest(w)
        h[i] = x
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the smallest second(first(x) + k) over the set, in a universe of 2^32 elements.

    ``first`` breaks up the order of the elements, ``second``, shifted circularly by k, stands for the k-th permutation.
    """
    first = permuted((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(first), 512):
        part = permuted(first[lo : lo + 512] + shifts, 0x21F0AAAD, 0x735A2D97)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, different between bands."""
    parts = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        key = (key ^ parts[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signatures(df: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, digest, bands, sketch`` of each row: size and digest of its shingle set, band keys, and a byte of each coordinate."""

    def run(texts: list[str]) -> list[list]:
        sizes, digests, keys, sketches = [], [], [], []
        for text in texts:
            h = shingle_hashes(word_list(text), k)
            sizes.append(len(h))
            if not len(h):
                digests.append(None), keys.append(None), sketches.append(None)
                continue
            sig = signature(h, bands * rows)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            keys.append(band_keys(sig, bands, rows))
            sketches.append((sig & 0xFF).astype(np.uint8).tobytes())
        return [sizes, digests, keys, sketches]

    columns = {"n": "bigint", "digest": "binary", "bands": "array<bigint>", "sketch": "binary"}
    return map_texts(df, id_col, text_col, columns, run).withColumnRenamed(id_col, "id")


def verified(pairs: DataFrame, df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those ``u, v`` of ``pairs`` with 100 * intersection >= percent * union of their full shingle sets."""
    need = write_and_reread(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "need")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    texts = df.select(df[id_col].cast("bigint").alias("id"), whole_text(df, text_col).alias("text")).join(need, "id", "left_semi")
    texts = write_and_reread(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("v_text")), "v").join(texts.select(F.col("id").alias("u"), F.col("text").alias("u_text")), "u")

    def shingles(text: str) -> set:
        words = word_list(text)
        return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            u, v, u_text, v_text = (b.column(c) for c in ("u", "v", "u_text", "v_text"))
            keep = []
            for i, hub in enumerate(u.to_pylist()):
                if hub != last:
                    last, left = hub, shingles(u_text[i].as_py())
                right = shingles(v_text[i].as_py())
                common = len(left & right)
                if 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(at), v.take(at)], ["u", "v"])

    return both.select("u", "v", "u_text", "v_text").mapInArrow(run, "u bigint, v bigint")


def sets_of(need: DataFrame, df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, hashes``: the full shingle sets of the rows named by ``need`` (column ``id``), as ascending 64-bit hashes."""
    need = write_and_reread(need.distinct(), "need")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    texts = df.select(df[id_col].cast("bigint").alias("id"), whole_text(df, text_col).alias("text")).join(need, "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    return map_texts(texts, "id", "text", {"hashes": "binary"}, lambda found: [[shingle_hashes(word_list(t), k).tobytes() for t in found]])


def in_cells(members: DataFrame, work, out: str) -> DataFrame:
    """``work`` on each two cells of each bucket: a function of an Arrow table of their rows, sorted by id, that returns columns or nothing.

    ``members`` has ``key, id`` and other columns. A bucket (``key``) is cut into cells of about CELL rows, and each two cells, or the only one with itself, meet
    in a group of their own with a column ``cell``; so no task holds a bucket.
    """
    tasks = partitions(members.sparkSession)
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    cut = members.join(sizes, "key").withColumn("cells", F.ceil(F.col("m") / CELL).cast("int")).drop("m")
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = cut.withColumns({"a": F.least("cell", "other"), "b": F.greatest("cell", "other")}).drop("cells", "other")
    cut = cut.repartition(tasks, "key", "a", "b").sortWithinPartitions("key", "a", "b", "id")
    names, fields = ("key", "a", "b"), [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            marks = [table.column(c).to_numpy() for c in names]
            edges = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(table)], strict=True):
                found = work(table.slice(lo, hi - lo)) if hi - lo > 1 else None
                if found is not None and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], fields)

        for b in batches:
            if not len(b):
                continue
            # the last group may go on in the next batch
            marks = [b.column(c).to_numpy() for c in names]
            changes = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            at = int(changes[-1]) if len(changes) else 0
            if waiting and any(waiting[-1].column(c)[len(waiting[-1]) - 1] != b.column(c)[0] for c in names):
                yield from finished(pa.Table.from_batches(waiting))
                waiting = []
            if at:
                yield from finished(pa.Table.from_batches([*waiting, b.slice(0, at)]))
                waiting = []
            waiting.append(b.slice(at))
        if waiting:
            yield from finished(pa.Table.from_batches(waiting))

    return cut.mapInArrow(run, out)


class Rows:
    """Rows of a group with what rules out pairs: components, sizes, earlier bands and sketches."""

    def __init__(self, table: pa.Table, percent: int):
        self.key, self.ids, self.component, self.cell, self.n = (table.column(c).to_numpy() for c in ("key", "id", "component", "cell", "n"))
        self.component = self.component.copy()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.here = int(np.argmax(self.bands[0] == self.key[0]))
        self.percent, self.two = percent, self.cell.min() != self.cell.max()

    def partners(self, i: int) -> np.ndarray:
        """Later rows that may be similar to row i and share no earlier band with it, the likeliest first."""
        rest = slice(i + 1, None)
        may = (self.component[rest] != self.component[i]) & (100 * np.minimum(self.n[rest], self.n[i]) >= self.percent * np.maximum(self.n[rest], self.n[i]))
        if self.two:
            may &= self.cell[rest] != self.cell[i]
        at = np.flatnonzero(may) + i + 1
        if len(at) and self.here:
            at = at[~np.any(self.bands[at, : self.here] == self.bands[i, : self.here], axis=1)]
        equal = np.count_nonzero(self.sketch[at] == self.sketch[i], axis=1)
        fair = equal >= (self.percent / 100 - MARGIN) * self.sketch.shape[1]
        return at[fair][np.argsort(-equal[fair], kind="stable")]


def links_between(members: DataFrame, nodes: DataFrame, sets, percent: int) -> DataFrame:
    """``u, v``: verified links that join the components of each bucket as far as its members' sets allow.

    ``members`` has ``key, id, component``, ``nodes`` has ``id, n, bands, sketch``, and ``sets`` is a function from ids to ``id, hashes``. A pair is looked at in the first band that it
    shares, unless its components are joined by then. Sizes and sketches rule out most pairs, so full sets are sent only for members that have any left. Only links that
    join components leave a task, fewer than it has rows.
    """

    def needed(table: pa.Table) -> tuple:
        rows = Rows(table, percent)
        hit = np.zeros(len(rows.ids), bool)
        for i in range(len(hit) - 1):
            at = rows.partners(i)
            hit[at] = True
            hit[i] |= len(at) > 0
        return rows.key[hit], rows.ids[hit]

    def joined(table: pa.Table) -> tuple:
        rows = Rows(table, percent)
        found: tuple[list, list] = [], []
        full = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        for i in range(len(rows.ids) - 1):
            for j in rows.partners(i):
                if rows.component[i] == rows.component[j]:
                    continue
                one, two = full[i], full[j]
                common = int(np.count_nonzero(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    found[0].append(rows.ids[i])
                    found[1].append(rows.ids[j])
                    rows.component[rows.component == rows.component[j]] = rows.component[i]
        return found

    known = members.join(nodes.select("id", "n", "bands", "sketch"), "id")
    left = write_and_reread(in_cells(known, needed, "key bigint, id bigint").distinct(), "needed")
    full = sets(left.select("id"))
    return in_cells(known.join(left, ["key", "id"]).join(full, "id"), joined, "u bigint, v bigint")


def cluster(df: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` (bigint), ``n_shingles, component_id, kept`` of each row: documents are linked if 100 * intersection >= percent * union of
    their sets of k-word shingles; a component is what links reach, named by its smallest id, and kept is the row that has this id.

    Texts with fewer than k words are one shingle; null and empty texts and those of white space have none, are linked with nothing and kept. Rows
    with a null id are linked with nothing, have a null component and are kept. Rows that repeat come back as often. An id should stand for one text: of several,
    the smallest is compared. Other columns are left out.

    Texts with equal sets form a class; only its smallest id goes on. Classes that share a band key form a bucket. First every
    class is verified against the smallest of each of its buckets, which settles groups of copies of any size with about as many pairs as rows. In buckets that
    still hold several components the pairs between these are then looked at, see `links_between`. So links are lost only where no band agrees, see BANDS.
    """
    all_rows = write_and_reread(signatures(df, k, bands, rows, id_col, text_col).withColumn("id", F.col("id").cast("bigint")), "signatures")
    sets = all_rows.where("n > 0 and id is not null")
    nodes = sets.groupBy("digest").agg(F.min(F.struct("id", "n", "bands", "sketch")).alias("r"), F.count("*").alias("copies"))
    nodes = write_and_reread(nodes.select("digest", "copies", "r.*"), "nodes")
    keys = nodes.select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    buckets = write_and_reread(keys.join(hubs, "key"), "buckets")
    pairs = write_and_reread(buckets.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    links = write_and_reread(verified(pairs, df, k, percent, id_col, text_col), "links")
    label = components(links)
    named = buckets.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = write_and_reread(named.join(mixed, "key"), "members")
    more = links_between(members, nodes, lambda ids: sets_of(ids, df, k, id_col, text_col), percent)
    label = components(links.unionAll(write_and_reread(more, "links")))
    named = nodes.join(label.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or label is not null")
    named = named.select("digest", F.coalesce("label", "id").alias("component_id"))
    out = all_rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
