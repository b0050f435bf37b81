"""Fingerprints that tell texts by edit distance: order MinHash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text

#: Words of a k-mer, and entries of a fingerprint; an entry takes two k-mers.
K, ENTRIES = 3, 64
#: Entries that one row of the aggregation makes: code for all at once is too long to be compiled well.
ORDERS = 8
#: In a run of more characters without a space every character is a word: scripts without spaces, minified code, encoded data.
LONG = 48
#: Low bits of a number that hold a place, enough for any text; the others hold a hash.
PLACE_BITS = 31
PLACE = (1 << PLACE_BITS) - 1
#: Rows of a block of neighbouring ids, while there are at most MAX_BLOCKS; the bounds of blocks are all that reaches the driver. Larger blocks are sorted and
#: read row by row, and spill.
BLOCK_ROWS, MAX_BLOCKS = 1000, 1 << 16


def lower_bound(sorted_array: Column, key: Column, steps: Column) -> Column:
    """How many numbers of an ascending array are less than ``key``, by halving; ``steps`` are powers of two from above half its size down to 1."""

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(sorted_array, at + step - 1) < key, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def steps_of(array: Column) -> Column:
    """Powers of two for `lower_bound`."""
    top = F.ceil(F.log2(F.size(array) + F.lit(1.0))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))


def place_of(v: Column) -> Column:
    return v.bitwiseAND(F.lit(PLACE))


def hash_of(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def with_kmers(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``, an array of the hash and place of each k-mer of a text (none for a text without words).

    Words lie between characters up to U+0020; runs of more than LONG characters count each character as a word. K-mers are K words each (all words, if
    fewer); those that repeat get, from the second on, a hash of their own and their number. Columns that begin with ``__`` are the operator's own.
    """
    runs = F.array_remove(F.split(df[text], r"[\x00-\x20]+", -1), "")
    cut = let(runs, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONG), F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > LONG, F.split(w, "", -1)).otherwise(F.array(w))))).otherwise(ws))
    df = df.withColumn("__words", cut)
    words = F.col("__words")
    last = F.greatest(F.size(words) - K, F.least(F.size(words) - 1, F.lit(0)))
    kmer = lambda i: packed(F.xxhash64(*(F.get(words, i + j) for j in range(K))), i.cast("bigint"))
    # every step refers to its array more than once, so that the optimizer keeps the steps apart and each array is made once
    df = df.withColumn("__kmers", F.when(F.size(words) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), kmer))).otherwise(F.array().cast("array<bigint>"))).drop("__words")
    df = df.withColumn("__steps", steps_of(F.col("__kmers")))
    kmers, steps = F.col("__kmers"), F.col("__steps")

    def numbered(v: Column, j: Column) -> Column:
        again = hash_of(F.get(kmers, j - 1)) == hash_of(v)
        first = lower_bound(kmers, v.bitwiseAND(F.lit(~PLACE)), steps)
        return F.when(again, packed(F.xxhash64(hash_of(v), j - first), place_of(v))).otherwise(v)

    return df.withColumn(name, F.transform(kmers, numbered)).drop("__kmers", "__steps")


def fingerprints(df: DataFrame, keys: list[str], kmers: str, name: str) -> DataFrame:
    """``keys`` and ``name``, an array of ENTRIES numbers, of the k-mers of each row (none if it has none). ``keys`` must tell rows apart.

    Every entry has a hash order of its own and takes the first and the last k-mer of it, puts them into text order and hashes them as a pair. First and
    last agree between two texts exactly as often as the two first would: where both ends of the joint order are common k-mers.
    K-mers become rows and orders aggregates, so all is compiled code; where ``df`` is distributed by some of the keys, nothing is shuffled.
    """
    rows = df.select(*keys, F.explode_outer(kmers).alias("__kmer"))
    rows = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(ENTRIES - ORDERS), F.lit(ORDERS))).alias("__from"), "__kmer")
    kmer, start = F.col("__kmer"), F.col("__from")
    rows = rows.select(*keys, "__from", *(packed(F.xxhash64(hash_of(kmer), start + e), place_of(kmer)).alias(f"__v{e}") for e in range(ORDERS)))
    ends = rows.groupBy(*keys, "__from").agg(*(end(f"__v{e}").alias(f"__{end.__name__}{e}") for e in range(ORDERS) for end in (F.min, F.max)))

    def entry(pair: Column) -> Column:
        one, two = pair["one"], pair["two"]
        first, last = (F.when((place_of(one) <= place_of(two)) == straight, hash_of(one)).otherwise(hash_of(two)) for straight in (F.lit(True), F.lit(False)))
        return F.shiftright(F.xxhash64(first, last), 32).cast("int")

    pairs = F.array(*(F.struct(F.col(f"__min{e}").alias("one"), F.col(f"__max{e}").alias("two")) for e in range(ORDERS)))
    some = F.when(F.col("__min0").isNotNull(), F.transform(pairs, entry)).otherwise(F.array().cast("array<int>"))
    parts = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__from", some.alias("some")))).alias("__parts"))
    return parts.select(*keys, F.flatten(F.col("__parts.some")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; 1 for two texts without words, 0 if one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.lit(float(ENTRIES)))


def listed(entries: Column) -> Column:
    """Entries as hexadecimal text."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (``id, text``) with ``__block, __more, __row, __next``: blocks of neighbouring ids, the place in the block, and the text of the next row.

    Null ids come first; rows of the same id are ordered by text. Rows are dealt into blocks by bounds taken from quantiles of the ids, so one shuffle brings
    neighbours together and no task holds more than its blocks. Every block ends with a copy (``__more``) of the first row of the block that follows, after the last block of
    the first one. Rows that tie are equal, so places are the same after a retry.
    """
    spark = rows.sparkSession
    ids = rows.select("id")
    blocks = min(MAX_BLOCKS, max(1, ids.count() // BLOCK_ROWS))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(ids.agg(F.percentile_approx("id", shares, 10 * max(1000, blocks))).first()[0] or [])) if shares else []
    array = F.from_json(F.lit(str(bounds)), "array<bigint>")  # one value in the plan
    key = F.col("id").cast("bigint") + 0
    steps = F.lit([1 << e for e in range(len(bounds).bit_length(), -1, -1)])
    block = F.when(F.col("id").isNull(), -1).otherwise(let(array, lambda a: lower_bound(a, key, steps)))
    ring = [r for r in ids.groupBy(block.alias("block")).agg(F.min("id").alias("id")).collect()]  # a row per block
    ring.sort(key=lambda r: r["block"])
    heads = spark.createDataFrame([(ring[i - 1]["block"], r["id"]) for i, r in enumerate(ring)], f"__block int, __head {ids.schema['id'].dataType.simpleString()}")
    copies = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("__head"))).groupBy("__block", "id").agg(F.min("text").alias("text"))
    every = rows.select(block.alias("__block"), F.lit(False).alias("__more"), "id", "text").unionAll(copies.select("__block", F.lit(True), "id", "text"))
    near = Window.partitionBy("__block").orderBy("__more", F.asc_nulls_first("id"), "text")
    return every.withColumns({"__row": F.row_number().over(near), "__next": F.lead("text").over(near)})


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text (null: empty) and of its edited text, and their likeness.

    The edited text has the last half of the characters (rounded down) replaced by as many from the start of the next row's text by ``id_col``, see `in_blocks`.
    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each row; other columns are left out. ``id_col`` must be a whole number.

    Texts are shuffled once, by block; k-mers, fingerprints and neighbours stay in the tasks that hold the block.
    """
    rows = in_blocks(df.select(df[id_col].alias("id"), whole_text(df, text_col).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("__next"), F.lit(1), half))
    rows = with_kmers(rows.withColumn("edited", edited), "text", "own_kmers")
    rows = with_kmers(rows, "edited", "edited_kmers")
    told = ["__block", "__row", "__more", "id", "n_chars", "edited_sha256"]
    rows = rows.withColumns({"n_chars": F.length("text").cast("bigint"), "edited_sha256": F.sha2("edited", 256)})
    both = rows.select(*told, F.posexplode(F.array("own_kmers", "edited_kmers")).alias("kind", "kmers"))
    both = fingerprints(both, [*told, "kind"], "kmers", "entries")
    rows = both.groupBy(*told).agg(F.max(F.when(F.col("kind") == 0, F.col("entries"))).alias("prints"), F.max(F.when(F.col("kind") == 1, F.col("entries"))).alias("edited_prints"))
    rows = rows.withColumn("__next", F.lead("prints").over(Window.partitionBy("__block").orderBy("__row"))).where("not __more")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        listed(F.col("prints")).alias("fingerprint"),
        listed(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("__next")).alias("near_next"),
    )
