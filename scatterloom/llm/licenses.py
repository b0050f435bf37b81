"""Licences named in texts: ordered signature rules behind a keyword filter. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text
from .license_rules import BASE, REACH, TABLE

#: What lies between words, in texts whose A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Strength of a rule by its priority.
STRENGTH = {1: 1.0, 2: 0.8, 3: 0.6}


@dataclass(frozen=True)
class Rule:
    """``regex`` counts from the start of a word; ``keyword`` is the word that it begins with."""

    priority: int
    label: str
    regex: str
    base: bool = False

    @property
    def keywords(self) -> list[str]:
        head = re.match(r"[0-9a-z\[\]]+", self.regex)[0]
        return [head.replace("[cs]", x) for x in "cs"] if "[cs]" in head else [head]


def rules() -> tuple[Rule, ...]:
    """The base phrases and then the table, in order."""
    found = [Rule(3, label, phrase, True) for label, phrase in BASE]
    for line in TABLE.strip().splitlines():
        head, _, regex = line.partition(" | ")
        priority, label = head.split()
        found.append(Rule(int(priority), label, regex))
    return tuple(found)


def words(df: DataFrame, text_col: str = "text") -> Column:
    """Words of the whole text (null: none) with A-Z in lower case; letters outside ASCII may change case as well, which no rule can see.

    The Kelvin sign is set aside first, since its lower case is an ASCII letter.
    """
    low = F.lower(F.replace(whole_text(df, text_col), F.lit("\u212a"), F.lit("\ue000")))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def rule_map(table: tuple[Rule, ...]) -> Column:
    """Rules by keyword; a constant of the plan."""
    by_word: dict[str, list[Column]] = {}
    for n, r in enumerate(table):
        row = F.struct(F.lit(r.priority).alias("priority"), F.lit(n).alias("rule"), F.lit(f"^(?:{r.regex}) ").alias("regex"))
        for word in r.keywords:
            by_word.setdefault(word, []).append(row)
    return F.create_map(*(x for word, rows in by_word.items() for x in (F.lit(word), F.array(*rows))))


def keywords(table: tuple[Rule, ...]) -> list[str]:
    return sorted({w for r in table for w in r.keywords})


def detections(words_col: Column, table: tuple[Rule, ...]) -> Column:
    """All matches of all rules as (start, back, priority, rule, end), sorted: by start, then the longer, then the better priority, then the earlier rule.

    The keyword filter picks the places to try; a rule sees the words from there on that it can reach, so the work per place is bounded.
    """
    places = F.filter(F.transform(words_col, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: p["word"].isin(*keywords(table)))

    def tried(p: Column) -> Column:
        window = F.concat(F.array_join(F.slice(words_col, p["at"] + 1, REACH), " "), F.lit(" "))
        return let(window, lambda text: F.filter(F.transform(rule_map(table)[p["word"]], lambda r: matched(p, text, r)), lambda d: d["end"] > d["start"]))

    def matched(p: Column, text: Column, r: Column) -> Column:
        found = F.call_function("regexp_extract", text, r["regex"], F.lit(0))
        end = p["at"] + F.length(found) - F.length(F.replace(found, F.lit(" ")))
        return F.struct(p["at"].alias("start"), (-end).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), end.alias("end"))

    return F.sort_array(F.flatten(F.transform(places, tried)))


def unsuppressed(found: Column) -> Column:
    """Detections without those whose interval lies in the interval of another one of the same or a better priority; of equal intervals and priorities the earlier rule stays.

    One pass in sorted order: it keeps the furthest end per priority.
    """
    none = F.array().cast("array<struct<start:int,back:int,priority:int,rule:int,end:int>>")
    begin = F.struct(*(F.lit(-1).alias(f"reach{p}") for p in STRENGTH), none.alias("out"))

    def step(acc: Column, d: Column) -> Column:
        reach = F.when(d["priority"] == 1, acc["reach1"]).when(d["priority"] == 2, acc["reach2"]).otherwise(acc["reach3"])
        ends = [F.greatest(acc[f"reach{p}"], F.when(d["priority"] <= p, d["end"])).alias(f"reach{p}") for p in STRENGTH]
        return F.struct(*ends, F.when(reach >= d["end"], acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(found, begin, step, lambda acc: acc["out"])


def scan(df: DataFrame, table: tuple[Rule, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words``, ``found`` (all detections) and ``kept`` (those that nothing suppresses) of each row's whole text.

    Null and empty texts have no words and empty arrays. Rows are independent and come back once each, also if ids are null or repeat;
    other columns are left out. There is no shuffle: texts without a keyword are done after the filter.
    """
    table = rules() if table is None else table
    none = F.array().cast("array<struct<start:int,back:int,priority:int,rule:int,end:int>>")
    rows = df.select(df[id_col].alias(id_col), words(df, text_col).alias("words"))
    gate = F.arrays_overlap("words", F.array(*map(F.lit, keywords(table))))
    rows = rows.select(id_col, F.size("words").cast("bigint").alias("n_words"), F.when(gate, detections(F.col("words"), table)).otherwise(none).alias("found"))
    return rows.select("*", F.when(F.size("found") > 0, unsuppressed(F.col("found"))).otherwise(none).alias("kept"))


def digest(found: DataFrame, table: tuple[Rule, ...] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Base places and labels, all labels, and the strength of the best detection (0 without any)."""
    table = rules() if table is None else table
    labels = F.array(*(F.lit(r.label) for r in table))
    n_base = sum(r.base for r in table)
    base = found.select("*", F.filter("found", lambda d: d["rule"] < n_base).alias("base"))
    named = lambda spans: F.array_distinct(F.transform(spans, lambda d: labels[d["rule"]]))
    best = F.array_min(F.transform("kept", lambda d: d["priority"]))
    score = F.lit(0.0)
    for priority, strength in STRENGTH.items():
        score = F.when(best == priority, strength).otherwise(score)
    return base.select(
        id_col,
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(named(F.col("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named(F.col("base")), named(F.col("kept")))), ",").alias("labels"),
        score.alias("score"),
    )
