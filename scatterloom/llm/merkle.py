"""Merkle manifest of a table: digests of rows, trees of fixed fanout per key, proofs of membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import partitions

#: Children of a node, and levels of the tree that one aggregate spreads into columns (FANOUT ** DEPTH of them).
FANOUT, DEPTH = 2, 4
#: Where a partition's number ends in what `monotonically_increasing_id` returns.
ROW_BITS = 33


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: of each field ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _digest(parts: Sequence[str]) -> str:
    """Digest, as 32 bytes, of digests as hexadecimal text one after the other; null ones are left out."""
    return f"unhex(sha2(concat_ws('', {', '.join(f'lower(hex({p}))' for p in parts)}), 256))"


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the ``proof`` of its place lead to, both digests as text."""

    def up(own: Column, step: Column) -> Column:
        others = as_text(step["others"])
        at = step["slot"] * 64
        return F.sha2(F.concat(F.substring(others, F.lit(1), at), own, F.substring(others, at + 1, F.length(others))), 256)

    return F.aggregate(proof, leaf, up)


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: as_text(step["others"])), ""), 256)


def _numbered(rows: DataFrame, order: Sequence[str], fanout: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, the place from 0 within ``key`` by ``order``, and the ``height`` of its key's tree; and ``key, n, height`` of each key.

    Rows are dealt by ranges of (key, order), so a key with most of the rows spreads over many tasks, and are numbered in the task that
    writes them. What is joined back has a row per key and range.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "key", *order).sortWithinPartitions("key", *order)
    dealt = write_and_reread(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-sorted")
    place = dealt.withColumns({"__range": F.shiftright("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)})
    ranges = place.groupBy("key", "__range").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    of_key = Window.partitionBy("key")
    before = of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # the least height at which a node takes all rows; in whole numbers, as logarithms of large counts may round
    powers = F.array(*(F.lit(fanout**h).cast("bigint") for h in range(63) if fanout**h < 2**62))
    ranges = ranges.withColumns({"__shift": F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"), "n": F.sum("__n").over(of_key)})
    ranges = write_and_reread(ranges.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("n")))), "merkle-ranges")
    sizes = ranges.select("key", "n", "height").distinct()
    numbered = place.join(ranges.select("key", "__range", "__shift", "height"), ["key", "__range"]).withColumn("pos", F.col("__row") + F.col("__shift"))
    return numbered.drop("__at", "__range", "__row", "__shift"), sizes


@dataclass
class Tree:
    """Pivoted levels of the trees of all keys, lowest first, and ``tops``: ``key, n, height, top``.

    A row of a pivot is a node ``depth`` levels above its children: ``key, parent, height``, columns ``c0, c1, ..`` with the child of each
    slot (null where the last run ends early) and ``top``.
    """

    fanout: int
    depth: int
    pivots: list[DataFrame]
    tops: DataFrame


def _levels(row: DataFrame, base: int, fanout: int, depth: int) -> tuple[DataFrame, list[list[str]]]:
    """Adds a column ``l<level>_<node>`` for each node above the slots; returns the names of all levels' nodes, the slots' first.

    A tree that is no higher than a level keeps its only node there.
    """
    levels = [[f"c{s}.digest" for s in range(fanout**depth)]]
    for j in range(1, depth + 1):
        runs = [levels[-1][i : i + fanout] for i in range(0, len(levels[-1]), fanout)]
        nodes = {f"l{j}_{t}": f"if({r[0]} is null, null, if(height >= {base + j}, {_digest(r)}, {r[0]}))" for t, r in enumerate(runs)}
        row = row.selectExpr("*", *(f"{e} as {n}" for n, e in nodes.items()))
        levels.append(list(nodes))
    return row, levels


def _tree(rows: DataFrame, order: Sequence[str], carried: Sequence[str], fanout: int, depth: int) -> Tree:
    """Trees over ``rows`` (``key, digest``, columns of ``order`` and ``carried``), one for each key."""
    numbered, sizes = _numbered(rows, order, fanout)
    highest = sizes.agg(F.max("height")).first()[0] or 0
    level = numbered.select("key", "pos", "height", F.struct("digest", *carried).alias("node"))
    pivots, base, width = [], 0, fanout**depth
    while base < highest or not pivots:
        spread = [F.expr(f"first(if(pos % {width} = {s}, node, null), true) as c{s}") for s in range(width)]
        grouped = level.groupBy("key", "height", F.expr(f"pos div {width}").alias("parent")).agg(*spread)
        row, levels = _levels(grouped, base, fanout, depth)
        pivot = write_and_reread(row.select(*grouped.columns, F.col(levels[-1][0]).alias("top")), "merkle-level")
        pivots.append(pivot)
        level = pivot.select("key", F.col("parent").alias("pos"), "height", F.struct(F.col("top").alias("digest")).alias("node"))
        base += depth
    return Tree(fanout, depth, pivots, sizes.join(level.select("key", F.col("node.digest").alias("top")), "key"))


def _proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """Down from ``above`` (``key, subroot, proof``: the steps over each tree's top): ``key, subroot, node, proof`` of each row of the tree.

    A step is ``slot`` and ``others``: the digests of the run's other nodes, that is its columns without the own slot's.
    """
    fanout, depth = tree.fanout, tree.depth
    down = above.withColumn("parent", F.lit(0).cast("bigint"))
    for k in reversed(range(len(tree.pivots))):
        width, base = fanout**depth, k * depth
        row = tree.pivots[k].drop("top").join(down, ["key", "parent"])
        row, levels = _levels(row, base, fanout, depth)
        children = []
        for s in range(width):
            steps = []
            for j in range(depth):
                at = s // fanout**j
                run, own = levels[j][at // fanout * fanout :][:fanout], at % fanout
                others = ", ".join(f"coalesce({c}, x'')" for i, c in enumerate(run) if i != own)
                steps.append(f"if(height > {base + j}, named_struct('slot', {own}, 'others', concat({others})), null)")
            children.append(f"named_struct('s', {s}, 'node', c{s}, 'proof', concat(array_compact(array({', '.join(steps)})), proof))")
        each = row.selectExpr("key", "subroot", "parent", f"explode(filter(array({', '.join(children)}), c -> c.node is not null)) as c")
        down = each.selectExpr("key", "subroot", f"parent * {width} + c.s as parent", "c.node as node", "c.proof as proof")
        if k:
            down = down.drop("node")
    return down.drop("parent")


@dataclass
class Manifest:
    """Trees of all keys and the tree of their tops, as tables in the scratch folder."""

    trees: Tree
    crown: Tree
    key: tuple[str, str]
    carried: dict[str, str]

    def subroots(self) -> DataFrame:
        """The key column, ``n`` rows, ``height``, ``subroot`` as text: a row for each key."""
        name, kind = self.key
        return self.trees.tops.select(_key_back("key", kind).alias(name), "n", "height", as_text(F.col("top")).alias("subroot"))

    def root(self) -> DataFrame:
        """One row with ``root`` as text; none for an empty table."""
        return self.crown.tops.select(as_text(F.col("top")).alias("root"))

    def proofs(self) -> DataFrame:
        """``leaf, subroot, root`` as text, ``proof`` (steps from the leaf to the root) and the carried columns of each row."""
        crown = self.crown.tops.select("key", F.lit(b"").alias("subroot"), F.array().cast("array<struct<slot:int,others:binary>>").alias("proof"))
        above = _proofs(self.crown, crown).select(F.col("node.name").alias("key"), F.col("node.digest").alias("subroot"), "proof")
        rows = _proofs(self.trees, above)
        found = self.root().first()
        root = F.lit(found and found["root"]).cast("string")
        return rows.select(
            as_text(F.col("node.digest")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"), "proof",
            *(F.col(f"node.{c}").alias(name) for name, c in self.carried.items()),
        )


def _key_back(key: str, kind: str) -> Column:
    return F.when(F.col(key) != "", F.substring(key, 2, 2**31 - 1)).cast(kind)


def manifest(df: DataFrame, leaf: Column, order: str, key: str, carried: Mapping[str, Column], fanout: int = FANOUT, depth: int = DEPTH) -> Manifest:
    """A tree over the rows of each value of ``key``, in ascending ``order``, and a tree over their roots.

    ``leaf`` is a row's digest as text (see `leaf_of`); ``carried`` columns go along to the proofs. While a level has several nodes, each
    ``fanout`` consecutive ones (fewer at the end) become their digest. One aggregate spreads ``depth`` levels below a node into
    ``fanout ** depth`` columns; the levels between are concatenated from these in the row, so ``depth`` sets how many shuffles there are
    and not what comes out.

    Null keys make a tree of their own that comes first; keys are in order of their UTF-8 bytes. Null orders come first, rows of equal
    order follow their digests, and rows that repeat are leaves of their own; equal ones are interchangeable. An empty table has no root and no proofs.
    No text passes a shuffle; a row travels as its digest, key, order and carried columns.
    """
    if fanout < 2 or depth < 1 or fanout**depth > 256:
        raise ValueError("fanout is 2 or more, depth 1 or more, and fanout ** depth 256 at most")
    coded = F.coalesce(F.concat(F.lit("k"), df[key].cast("string")), F.lit(""))
    names = {name: f"x{i}" for i, name in enumerate(carried)}
    rows = df.select(coded.alias("key"), F.unhex(leaf).alias("digest"), df[order].alias("order"), *(c.alias(names[n]) for n, c in carried.items()))
    rows = write_and_reread(rows, "merkle-leaves")  # ranges are sampled first: texts are digested once
    trees = _tree(rows, ["order", "digest"], list(names.values()), fanout, depth)
    tops = trees.tops.select(F.lit("").alias("key"), F.col("top").alias("digest"), F.col("key").alias("name"))
    crown = _tree(write_and_reread(tops, "merkle-tops"), ["name"], ["name"], fanout, depth)
    return Manifest(trees, crown, (key, df.schema[key].dataType.simpleString()), names)
