"""Lines that occur again, exactly or but for one word: a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import let, whole_text

#: Empty lines are left alone, exact repeats go at any length; one word may differ where both lines have NEAR_WORDS or more.
NEAR_WORDS = 8
#: Lines whose places are broadcast at most (a few numbers each); beyond, their texts are fetched by a shuffle.
BROADCAST_ROWS = 500_000

LOW = (1 << 31) - 1


def distinct_lines(df: DataFrame) -> DataFrame:
    """``line, n, at, keys`` of each distinct line: hash and count of its words, its earliest place (id and number in the text), and hashes of its halves.

    ``df`` has ``id`` and ``text``. Spaces around a line don't count; words lie between single spaces. Counts are made before the
    shuffle, so a line that is everywhere arrives there once per task.

    Two lines one edit apart agree in the first or the second half of the shorter one. A line of n words can be the shorter (n) or the
    longer one (n - 1), which makes four halves.
    """
    rows = df.select("id", F.posexplode(F.split("text", "\n", -1)).alias("number", "raw")).select("id", "number", F.trim("raw").alias("raw"))
    rows = rows.withColumn("n", F.length("raw") - F.length(F.replace("raw", F.lit(" "))) + 1).where(F.col("raw") != "")

    def half(shorter: Column, first: bool) -> Column:
        size = F.floor(shorter / 2).cast("int")
        part = F.call_function("substring_index", "raw", F.lit(" "), size if first else size - shorter)
        return F.xxhash64(shorter, F.lit(first), part)

    halves = F.array(*(half(F.col("n") - less, first) for less in (0, 1) for first in (True, False)))
    rows = rows.select(F.xxhash64("raw").alias("line"), "n", F.struct("id", "number").alias("at"), F.when(F.col("n") >= NEAR_WORDS, halves).alias("keys"))
    found = rows.groupBy("line", "n").agg(F.min("at").alias("at"), F.first("keys").alias("keys"))
    return write_and_reread(found, "lines")


def with_words(near: DataFrame, df: DataFrame) -> DataFrame:
    """``line, n, at, words`` of the lines that share a half with another one, fetched from the text of their earliest place."""
    halves = near.select("line", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("key")
    wanted = halves.join(shared, "key", "left_semi").select("line").distinct()
    places = near.select("line", "n", "at").join(wanted, "line")
    places = places.groupBy(F.col("at.id").alias("at_id")).agg(F.collect_list(F.struct("line", "n", "at")).alias("places"))
    places = write_and_reread(places, "places")
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_ROWS
    texts = df.join(F.broadcast(places) if few else places, F.col("id").eqNullSafe(F.col("at_id")))
    fetched = let(F.split("text", "\n", -1), lambda ls: F.transform("places", lambda p: F.struct(p["line"].alias("line"), p["n"].alias("n"), p["at"].alias("at"), F.trim(F.get(ls, p["at"]["number"])).alias("raw"))))
    rows = texts.select(F.explode(fetched).alias("p")).select("p.*")
    # an id that repeats can bring another text: only the line that was meant goes on
    rows = rows.where(F.xxhash64("raw") == F.col("line")).dropDuplicates(["line", "n"])
    return write_and_reread(rows.select("line", "n", "at", F.split("raw", " ", -1).alias("words")), "near")


def variants(rows: DataFrame) -> DataFrame:
    """``key, whole, line, n, at``: the deletion neighbourhood of each line, a row per variant; ``whole`` tells the line itself from its variants.

    Two kinds of keys: the words but the i-th, together with i (equal for lines that differ in their i-th word), and a line's words as a
    sequence (equal for a line and a longer one without a word). Both are sums over words or pairs of neighbours, so a variant costs the same at any length.
    Pairs of neighbours may rarely agree for different sequences, which the verification finds out.
    """
    words = F.col("words")
    part = lambda h, high: (F.shiftright(h, 32) if high else h).bitwiseAND(F.lit(LOW))
    placed = lambda i: F.xxhash64(F.get(words, i), i)
    neighbours = lambda i, j: F.xxhash64(F.coalesce(F.get(words, i), F.lit("\n")), F.lit(1), F.coalesce(F.get(words, j), F.lit("\n")))
    every = F.sequence(F.lit(0), F.col("n") - 1)

    def total(values: Column, high: bool) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, h: a + part(h, high))

    rows = rows.select("*", F.transform(every, placed).alias("own"), F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: neighbours(i - 1, i)).alias("pairs"))
    rows = rows.select("*", *(total(F.col(c), high).alias(f"{c}{int(high)}") for c in ("own", "pairs") for high in (False, True)))

    def without(i: Column) -> Column:
        same = F.xxhash64(F.lit("same"), "n", i, *(F.col(f"own{int(high)}") - part(F.get("own", i), high) for high in (False, True)))
        joint = neighbours(i - 1, i + 1)
        rest = (F.col(f"pairs{int(high)}") - part(F.get("pairs", i), high) - part(F.get("pairs", i + 1), high) + part(joint, high) for high in (False, True))
        return F.array(same, F.xxhash64(F.lit("less"), F.col("n") - 1, *rest))

    itself = F.xxhash64(F.lit("less"), "n", "pairs0", "pairs1")
    keys = F.concat(F.array(F.struct(itself.alias("key"), F.lit(1).alias("kind"))), F.flatten(F.transform(every, lambda i: let(without(i), lambda k: F.array(F.struct(k[0].alias("key"), F.lit(0).alias("kind")), F.struct(k[1].alias("key"), F.lit(2).alias("kind")))))))
    return rows.select("line", "n", "at", F.explode(keys).alias("k")).select("k.key", "k.kind", "line", "n", "at")


def one_edit(a: Column, b: Column) -> Column:
    """Whether word arrays, ``b`` not the longer one by more than a word, are at most one word's edit apart."""

    def apart(x: Column, y: Column) -> Column:  # y has one word more: beyond the common start, x must go on as y does after a word
        same = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.size(x)), lambda i: F.get(x, i).eqNullSafe(F.get(y, i))), lambda e: ~e))
        start = F.array_position(F.transform(F.sequence(F.lit(0), F.size(x)), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))), True).cast("int") - 1
        return (same > 0) & (F.slice(x, start + 1, F.size(x)) == F.slice(y, start + 2, F.size(y)))

    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: ~e))
    return F.when(F.size(a) == F.size(b), changed <= 1).when(F.size(a) + 1 == F.size(b), apart(a, b)).when(F.size(b) + 1 == F.size(a), apart(b, a)).otherwise(False)


def near_copies(rows: DataFrame) -> DataFrame:
    """``line`` of those ``rows`` that have an earlier line one edit apart.

    Lines that share a key of the first kind are all one edit apart, and so are a line and the longer ones that have it as a
    variant; so every line is held against the earliest of its key only, and copies of one line make as many pairs as rows at any size of the group. If the words of a pair turn out to differ
    by more (its hashes agree by chance), the line is held against all earlier ones of that key.
    """
    keyed = write_and_reread(variants(rows), "variants")
    first = keyed.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.struct("at", "line"))).alias("same"),
        F.min(F.when(F.col("kind") == 1, F.struct("at", "line"))).alias("itself"),
        F.min(F.when(F.col("kind") == 2, F.struct("at", "line"))).alias("longer"),
        F.count("*").alias("m"),
    )
    met = keyed.join(first.where("m > 1").drop("m"), "key")
    other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("longer")).otherwise(F.col("itself"))
    met = met.withColumn("other", other).where((F.col("other.line") != F.col("line")) & (F.col("other.at") < F.col("at")))
    pairs = write_and_reread(met.groupBy("line", F.col("other.line").alias("other")).agg(F.min(F.struct("key", "kind")).alias("by")), "pairs")

    def verdict(pairs: DataFrame) -> DataFrame:
        of = lambda c, w: rows.select(F.col("line").alias(c), F.col("words").alias(w))
        return pairs.join(of("line", "a"), "line").join(of("other", "b"), "other").select("line", "by", one_edit(F.col("a"), F.col("b")).alias("near"))

    told = write_and_reread(verdict(pairs), "verdicts")
    near = told.where("near").select("line").distinct()
    chance = told.where("not near").join(near, "line", "left_anti").select("line", "by.key", "by.kind")
    if chance.isEmpty():
        return near
    mine = keyed.join(chance.distinct(), ["line", "key", "kind"]).select("line", "key", "kind", "at")
    others = keyed.select("key", F.col("kind").alias("other_kind"), F.col("line").alias("other"), F.col("at").alias("other_at"))
    more = mine.join(others, "key").where("other_at < at and (kind = 0 and other_kind = 0 or kind = 1 and other_kind = 2 or kind = 2 and other_kind = 1)")
    return near.union(verdict(more.select("line", "other", F.struct("key", "kind").alias("by")).distinct()).where("near").select("line")).distinct()


def kept_lines(df: DataFrame) -> DataFrame:
    """``kept_id, numbers``: the lines of each text that stay, of those that are not empty. ``df`` has ``id`` and ``text``."""
    all_lines = distinct_lines(df)
    long = all_lines.where(F.col("n") >= NEAR_WORDS)
    again = near_copies(with_words(long, df))
    return all_lines.join(again, "line", "left_anti").groupBy(F.col("at.id").alias("kept_id")).agg(F.collect_set("at.number").alias("numbers"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", new_text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``df`` with ``new_text`` (the text without lines that came before), ``n_lines`` and ``n_dropped`` (bigint), which replace columns of these names.

    Texts are cut at line feeds. Lines come in the order of the ids (null first) and then of the text. A line goes if an equal one came before, or if one came before that
    a word's insertion, deletion or replacement away and both have NEAR_WORDS words or more; whether that one itself goes doesn't matter. Empty lines
    stay. Null texts count as empty and have one line. An id should stand for one text: rows that repeat one share its kept lines. Columns that begin with ``__`` are
    the operator's own; all other columns stay, and every row comes back once.
    """
    rows = df.withColumns({"__id": df[id_col], "__text": whole_text(df, text_col)})
    kept = kept_lines(rows.select(F.col("__id").alias("id"), F.col("__text").alias("text")))
    rows = rows.join(kept.withColumnsRenamed({"kept_id": "__kept_id", "numbers": "__numbers"}), F.col("__id").eqNullSafe(F.col("__kept_id")), "left").drop("__kept_id")

    def stays(lines: Column) -> Column:
        empty = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
        return F.sort_array(F.concat(empty, F.coalesce("__numbers", F.array().cast("array<int>"))))

    made = let(F.split("__text", "\n", -1), lambda lines: let(stays(lines), lambda at: F.struct(F.size(lines).cast("bigint").alias("n"), F.size(at).cast("bigint").alias("kept"), F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n").alias("text"))))
    rows = rows.withColumn("__made", made)
    rows = rows.withColumns({new_text: F.col("__made.text"), n_lines: F.col("__made.n"), n_dropped: F.col("__made.n") - F.col("__made.kept")})
    return rows.drop("__id", "__text", "__numbers", "__made")
