"""Secrets in texts: a trigram index picks rows for each rule, regexes verify them. DataFrame functions only."""

from __future__ import annotations

import re._constants as code
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import let, whole_text

#: Rows that the broadcast table of candidates has at most (two numbers each); beyond, candidates are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Strings that a rule is unfolded into at most; a part that would need more counts as unknown text.
UNFOLD = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``regex`` that don't overlap, dropped unless ``group`` has ``least`` characters. The syntax must mean the same in Java, Python and RE2."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Kinds in the order in which spans with the same start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, True),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24, True),
    Rule("private_key", r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)"),
    Rule("forge_token", r"(gh[oprsu]_[A-Za-z0-9]{36,255}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat_token", r"(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("payment_key", r"([rs]k_(?:live|test)_[A-Za-z0-9]{16,})"),
    Rule("cloud_key", r"(AIza[A-Za-z0-9_-]{35})"),
    Rule("registry_token", r"(npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,})"),
    Rule("mail_key", r"(SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"),
    Rule("web_token", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)"),
    Rule("bearer", r"(?i:(bearer))\x20+([A-Za-z0-9._~+/-]{20,}=*)", 2, 20),
    Rule("url_login", r"([A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@)"),
)


def literal_runs(tree) -> list[list[str]]:
    """Ways to match a parsed regex, each as the literal strings that it must contain, in order; an empty string marks unknown text between two."""

    def joined(a: list[str], b: list[str]) -> list[str]:
        return [*a[:-1], a[-1] + b[0], *b[1:]]

    unknown = [["", ""]]
    ways = [[""]]
    for op, arg in tree:
        if op is code.LITERAL:
            part = [[chr(arg)]]
        elif op is code.IN and all(o is code.LITERAL for o, _ in arg):
            part = [[chr(c)] for _, c in arg]
        elif op is code.BRANCH:
            part = [w for x in arg[1] for w in literal_runs(x)]
        elif op is code.SUBPATTERN:
            part = literal_runs(arg[3])
        elif op is code.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            part = [[""], *literal_runs(arg[2])]
        elif op is code.MAX_REPEAT and arg[0] >= 1:
            part = [joined(w, ["", ""]) if arg[1] > 1 else w for w in literal_runs(arg[2])]
        elif op is code.AT:
            part = [[""]]
        else:
            part = unknown
        if len(part) * len(ways) > UNFOLD:
            part = unknown
        ways = [joined(a, b) for a in ways for b in part]
    return ways


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Sets of trigrams in lower case: a text that matches holds all of at least one set. Empty if there is a way to match without any trigram."""
    sets = set()
    for way in literal_runs(parser.parse(regex)):
        runs = [run.lower() for run in way]
        sets.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def row_key(df: DataFrame, id_col: str) -> Column:
    return F.xxhash64(df[id_col])


def postings(df: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index on ``trigrams``: ``trigram`` (its place in the list) and ``key`` of each row that holds it in either case, once.

    Rows whose ids have the same hash share a key, which can only make more candidates.
    """
    low = df.select(row_key(df, id_col).alias("key"), F.lower(whole_text(df, text_col)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(n)) for n, t in enumerate(trigrams))))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and ``rules`` (places in the list) whose trigram query holds for a row: postings are intersected per set of trigrams, the sets of a rule united.

    Counts are made before the shuffle, one row per key and set; keys are spread evenly. Postings of rows that
    share a key may count twice, which again can only make more candidates.
    """
    sets = [(n, s) for n, r in enumerate(rules) for s in trigram_query(r.regex)]
    trigrams = sorted({t for _, s in sets for t in s})
    member = [(trigrams.index(t), at, len(s), n) for at, (n, s) in enumerate(sets) for t in s]
    terms = df.sparkSession.createDataFrame(member, "trigram int, at int, size int, rule int")
    hits = postings(df, trigrams, id_col, text_col)
    found = hits.join(F.broadcast(terms), "trigram").groupBy("key", "at", "size", "rule").agg(F.count("*").alias("n"))
    return found.where("n >= size").groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches in code points, in order, the end exclusive."""
    parts = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("part"),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(text.rlike(rule.regex), let(parts, lambda p: _placed(p, rule.least))).otherwise(none)


def _placed(parts: Column, least: int) -> Column:
    """Spans of the matches of ``parts`` (text before each one, the match, its part that counts).

    Places are sums of lengths in two steps, within runs of about the cube root of all matches and over the runs' totals, so that no array
    is copied for every match: n matches take about n^(4/3) steps.
    """
    zero = F.lit(0).cast("bigint")
    length = lambda p: F.length(p["before"]) + F.coalesce(F.length(p["found"]), F.lit(0))
    size = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(parts)))).cast("int")
    one = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))

    def inside(run: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start, end = acc["at"] + F.length(p["before"]), acc["at"] + length(p)
            out = F.when(F.length(p["part"]) >= least, F.concat(acc["out"], one(start, end))).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        return F.aggregate(run, begin, step, lambda acc: acc["out"])

    def in_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, zero, lambda acc, p: acc + length(p)))
        starts = F.aggregate(totals, F.array(zero), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
        return let(starts, lambda at: F.flatten(F.transform(runs, lambda r, k: inside(r, at[k]))))

    cut = F.transform(F.sequence(F.lit(1), F.size(parts), size), lambda lo: F.slice(parts, lo, size))
    return let(cut, in_runs)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array of (start, rank, kind, end) by start and then the order of the rules, over the whole text (null: empty).

    Rules with mandatory trigrams are tried on the rows that their trigram query finds, the others on all rows. Every row comes back
    once, whether its id is null or repeats; texts without a match have an empty array; other columns are left out.
    The table of candidates is written to the scratch folder and counted: it is broadcast up to ``BROADCAST_ROWS`` rows, else joined by a shuffle.
    """
    found = write_and_reread(candidates(df, rules, id_col, text_col), "candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = df.select(df[id_col].alias("id"), row_key(df, id_col).alias("key"), whole_text(df, text_col).alias("text")).join(found, "key", "left")
    all_spans = []
    for n, rule in enumerate(rules):
        own = spans(F.col("text"), rule)
        if trigram_query(rule.regex):
            own = F.when(F.array_contains("rules", n), own).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        all_spans.append(_ranked(own, n, rule.kind))
    return rows.select(F.col("id").alias(id_col), F.sort_array(F.concat(*all_spans)).alias("spans"))


def _ranked(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = {r.kind: n for n, r in enumerate(rules) if r.base}
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, n))).cast("bigint").alias(f"n_{kind}") for kind, n in base.items()]
    own = F.filter("spans", lambda s: s["rank"].isin(*base.values()))
    return found.select(id_col, *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
