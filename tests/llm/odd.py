"""Tables with all that operators must bear."""

from __future__ import annotations

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, n int, key string, label string, kept string, at string, line string, words string, spans string"
WORDS = "the quick brown fox jumps over a lazy dog while eleven grey birds look down from old trees near our river".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] + ("" if (i + seed) % 3 else str(seed)) for i in range(n))


def documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and texts, ids beyond 2^53, and columns whose names operators use themselves."""
    texts = [
        (1, sentence(1, 60)), (2, None), (3, ""), (4, " \n\t \n"), (5, sentence(1, 60)), (6, sentence(1, 59) + " changed"), (7, "one"), (8, "One\nONE"),
        (9, sentence(9, 20_000) + "\n" + "word " * 20_000), (10, sentence(10, 40) + "\n" + sentence(11, 30)), (11, sentence(11, 30) + "\n" + sentence(10, 40)),
        (12, sentence(12, 50)), (12, sentence(12, 50)), (2**60 + 1, "é漢字🙂 " * 30), (None, sentence(13, 30)), (None, None), (-5, sentence(1, 60).upper()),
        (14, "\x00\x01 K ſ İ"),
    ]
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        source = None if i % 7 == 3 else "" if i % 7 == 4 else f"s{i % 3}"
        rows.append((doc_id, text, None if i % 2 else "en", source, None if text is None else len(text), None, None, i, "k", None, "x", None, None, "w", None))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def collected(df) -> list:
    """Rows as tuples, in an order that doesn't depend on the plan."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(df) -> list[tuple]:
    """(doc_id, whole text) of every row."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
