"""The manifest against a plain tree over lists."""

import hashlib
import zlib

import odd
import pytest
from pyspark.sql import functions as F

from scatterloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and for each node the slots and siblings on its way up."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fanout * fanout :][:fanout]
            ways[i].append((p % fanout, "".join(run[: p % fanout] + run[p % fanout + 1 :])))
            at[i] = p // fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def fold(own, way):
    for slot, others in way:
        own = h(others[: 64 * slot] + own + others[64 * slot :])
    return own


def plain(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof's digest, folded root of the tampered row) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: b"" if x is None else b"k" + x.encode())
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: ((r[0] is not None, r[0] or 0), leaf(*r)))
        trees.append((own, *tree([leaf(*r) for r in own], fanout)))
    root, crown = tree([t[1] for t in trees], fanout)
    out = []
    for (own, top, ways), above in zip(trees, crown, strict=True):
        for r, way in zip(own, ways, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            way = way + above
            out.append((r[0], leaf(*r), top, root, h("".join(o for _, o in way)), fold(leaf(*r[:3], r[3] + 1, r[4]) if bad else leaf(*r), way)))
    return sorted(out, key=repr)


def made(df, **how):
    fields = lambda n: merkle.leaf_of(df["doc_id"], df["source"], df["lang"], n, df["text"])
    bad = F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 == 0
    given = F.when(bad, fields(df["n_chars"].cast("decimal(20,0)") + 1)).otherwise(fields(df["n_chars"]))
    rows = merkle.manifest(df, fields(df["n_chars"]), "doc_id", "lang", {"doc_id": df["doc_id"], "given": given}, **how).proofs()
    return odd.collected(rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")), merkle.folded(F.col("given"), F.col("proof"))))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("how", [{}, {"depth": 1}, {"fanout": 3, "depth": 2}])
def test_odd_rows(spark, how):
    df = odd.documents(spark)
    assert made(df, **how) == plain(rows_of(df), how.get("fanout", 2))


def test_sizes(spark):
    """Keys of few rows and one with most of them, null and empty keys, largest counts."""
    rows = [(1000 * n + i * 7 % 101, "s", f"l{n}", i, f"text {i}") for n in (1, 2, 3, 8, 9, 16, 17, 65) for i in range(n)]
    rows += [(500, None, None, 2**63 - 1, None), (501, "s", "", None, "x"), (503, "", "zz", 2**63 - 1, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert made(df) == plain(rows)


def test_empty_table_and_subroots(spark):
    df = odd.empty(spark)
    m = merkle.manifest(df, merkle.leaf_of(df["doc_id"]), "doc_id", "lang", {"doc_id": df["doc_id"]})
    assert m.proofs().columns == ["leaf", "subroot", "root", "proof", "doc_id"]
    assert not (m.proofs().collect() or m.root().collect() or m.subroots().collect())
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, key int")
    m = merkle.manifest(df, merkle.leaf_of(df["id"]), "id", "key", {"id": df["id"]})
    want = {k: tree([leaf(i) for i in range(k, 20, 3)], 2)[0] for k in range(3)}
    assert {r.key: (r.n, r.subroot) for r in m.subroots().collect()} == {k: (len(range(k, 20, 3)), t) for k, t in want.items()}
    assert m.root().first().root == tree(list(want.values()), 2)[0]


def test_a_change_is_found_by_its_proof(spark):
    df = spark.range(40).select("id", F.lit("a").alias("key"))
    proofs = merkle.manifest(df, merkle.leaf_of(df["id"]), "id", "key", {"id": df["id"]}).proofs()
    ok = lambda leaf: merkle.folded(leaf, F.col("proof")) == F.col("root")
    assert proofs.where(~ok(F.col("leaf")) | ok(merkle.leaf_of(F.col("id") + 1))).count() == 0


def test_bad_shapes(spark):
    df = odd.empty(spark)
    for how in ({"fanout": 1}, {"depth": 0}, {"fanout": 4, "depth": 5}):
        with pytest.raises(ValueError):
            merkle.manifest(df, merkle.leaf_of(df["doc_id"]), "doc_id", "lang", {}, **how)
