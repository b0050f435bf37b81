"""From raw documents to token ids: quality, repeated lines, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), calls one operator of ``scatterloom.llm`` and returns a table, which is written and read again as the
next stage's documents. Columns of ``docs`` other than those that a stage is about go through it unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scatterloom.llm import bpe, lines, minhash, mixing, quality
from scatterloom.llm.common import table
from scatterloom.scratch import write_and_reread

#: Columns that tell a row's place in the mixed order.
PLACE = ["mix_file", "mix_row"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned on these ones, finds bad (score under 0.5)."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    return model.score(rows, "row", "text").where("score >= 0.5").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; those that lost lines and have none left but empty ones go. ``n_chars`` is counted anew."""
    rows = lines.dedup(docs, new_text="__new", n_lines="__lines", n_dropped="__dropped")
    left = F.exists(F.split("__new", "\n", -1), lambda x: F.trim(x) != "")
    rows = rows.where((F.col("__dropped") == 0) | left)
    changed = F.col("__dropped") > 0
    new = {"text": F.when(changed, F.col("__new")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("__new").cast("bigint")).otherwise(F.col("n_chars"))}
    return rows.withColumns({c: e for c, e in new.items() if c in docs.columns}).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8), the one with the smallest id.

    Rows that repeat an id and its text are one document. An id with unlike texts names several, which its group doesn't tell apart: all of
    these stay. Documents without an id all stay.
    """
    kept = minhash.cluster(docs, k=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    print_of = F.md5(F.coalesce(F.concat(F.lit("t"), docs["text"]), F.lit("")).cast("binary"))
    prints = docs.select(docs["doc_id"].alias("__id"), print_of.alias("__print")).where("__id is not null").groupBy("__id")
    told = prints.agg(F.min("__print").alias("__first"), F.max("__print").alias("__last"), F.count("*").alias("__n"))
    told = told.join(kept.withColumn("__kept", F.lit(True)), "__id", "left").where("__kept or __first <> __last")
    rows = docs.withColumn("__print", print_of).join(told, docs["doc_id"] == told["__id"], "left").where("__id is not null or doc_id is null")
    # ids are numbered only where they repeat, so the window holds few rows
    turn = F.row_number().over(Window.partitionBy("doc_id", "__print").orderBy("doc_id"))
    once = rows.where("coalesce(__n, 1) = 1")
    again = rows.where("__n > 1").withColumn("__turn", turn).where("__turn = 1")
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order in which sources are interleaved at weights in proportion to the square roots of their sizes; files and rows come in this order."""
    rows = mixing.mix(docs, mixing.shares_by_size(docs))
    return mixing.in_mixed_order(rows).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as counts and digests, with a digest of the text decoded from them, and its place in the order that the
    files of ``docs`` were written in: ``mix_file, mix_row``, the number of its part file and the row there (null if ``docs`` isn't read from such files).

    Scans deal files out by size, so rows carry the order that mixing gave them.
    """
    try:
        files = docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        files = None
    if files is None:
        place = [F.lit(None).cast("bigint").alias(c) for c in PLACE]
    else:
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
        place = [number.alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
    rows = docs.select(F.struct("doc_id", *place).alias("row"), "text")
    made = bpe.digests(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, id_col="row")
    return made.select("row.*", *(c for c in made.columns if c != "row"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("encode", encoded),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir`` on; rows come in the mixed order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_reread(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs.orderBy(*PLACE)
