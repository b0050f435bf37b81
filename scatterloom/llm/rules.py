"""Quality rules: statistics of texts, and ordered lists of threshold rules learned from labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_and_reread
from .common import map_texts
from .quality import held_out

#: Words of a window whose repeats count.
WINDOW = 5
#: Labelled rows that rules are learned from at most; of more, those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Thresholds tried for a statistic, conditions of a rule, and rules of a list at most.
CUTS, CONDITIONS, RULES = 64, 4, 24
#: Words of texts that are looked at in one step.
STEP = 1 << 20

WHITE = re.compile("[\x20\x09-\x0d]")
SYMBOLS = re.compile("[#*$%&|<>]")

#: What `statistics` counts for each text.
COUNTS = {
    "n_words": "words, runs of other characters than U+0009 to U+000D and spaces",
    "word_chars": "characters in words",
    "n_symbols": "characters of #*$%&|<>",
    "n_lines": "lines with a word",
    "n_dup_lines": "lines with a word that an earlier line equals",
    "n_repeat_words": "words in windows of five words that are found twice or more",
    "n_distinct_words": "different words",
    "n_same_as_before": "words that the one before equals",
    "n_upper_words": "words of two characters or more in capitals",
    "n_digits": "digits 0 to 9",
    "n_marks": "ASCII characters in words that are neither letters nor digits",
    "n_letters": "ASCII letters",
    "n_unended_lines": "lines with a word that end in a letter or digit",
}
#: What rules may ask: the numbers that stand for a text of any length.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "same_share": "n_same_as_before / greatest(n_words, 1)",
    "upper_share": "n_upper_words / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "unended_share": "n_unended_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of ``keys``."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def in_repeats(doc: np.ndarray, word: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a window of ``size`` words of its text that is found there twice or more.

    Windows get numbers by doubling: two numbers of half as long ones, compared exactly and not by a hash.
    """
    marked = np.zeros(len(word), bool)
    if len(word) < size:
        return marked
    name, length = ranks(word, doc), 1
    while length < size:
        step = min(length, size - length)
        name = ranks(name[step:], name[:-step])
        length += step
    inside = np.flatnonzero(doc[: len(name)] == doc[size - 1 :])
    name = name[inside]
    start = inside[np.bincount(name)[name] > 1]
    for k in range(size):
        marked[start + k] = True
    return marked


def _count(texts: Sequence[str]) -> pd.DataFrame:
    found = [t.encode().split() for t in texts]  # bytes are split at exactly these six characters
    n = len(texts)
    n_words = np.array([len(w) for w in found], np.int64)
    doc = np.repeat(np.arange(n), n_words)
    flat = list(chain.from_iterable(found))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    capital = np.fromiter((len(w) > 1 and w.isupper() for w in numbers), bool, len(numbers))
    per_doc = lambda rows: np.bincount(doc[rows], minlength=n)
    order = np.lexsort((word, doc))
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    lines = []
    for t in texts:
        seen: set[str] = set()
        dup = unended = filled = 0
        for line in t.split("\n"):
            last = line.rstrip(" \t\r\x0b\x0c")[-1:]
            if not last:
                continue
            filled += 1
            unended += last.isalnum()
            dup += line in seen
            seen.add(line)
        lines.append((filled, dup, unended))
    n_lines, n_dup, n_unended = np.array(lines, np.int64).reshape(n, 3).T
    out = {
        "n_words": n_words, "word_chars": [len(t) - len(WHITE.findall(t)) for t in texts], "n_symbols": [len(SYMBOLS.findall(t)) for t in texts],
        "n_lines": n_lines, "n_dup_lines": n_dup, "n_repeat_words": per_doc(in_repeats(doc, word)), "n_distinct_words": per_doc(order[first]),
        "n_same_as_before": per_doc(again), "n_upper_words": per_doc(capital[word]) if len(word) else np.zeros(n, np.int64), "n_unended_lines": n_unended,
    }
    kinds = np.array([np.bincount(CLASSES[np.frombuffer(t.encode(), np.uint8)], minlength=4)[1:] for t in texts], np.int64).reshape(n, 3)
    out |= dict(zip(("n_digits", "n_letters", "n_marks"), kinds.T, strict=True))
    return pd.DataFrame(out, columns=list(COUNTS)).astype(np.int64)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for i in range(33, 127):
        c = chr(i)
        kind[i] = 1 if c.isdigit() else 2 if c.isalpha() else 3
    return kind


#: Of each byte: 1 a digit, 2 an ASCII letter, 3 another printable ASCII character, 0 anything else.
CLASSES = _classes()


def count(texts: Sequence[str]) -> pd.DataFrame:
    """`COUNTS` of each text, in steps of about ``STEP`` characters or one longer text."""
    parts, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > STEP:
            parts.append(_count(texts[lo:i]))
            lo, size = i, 0
        size += len(t)
    parts.append(_count(texts[lo:]))
    return pd.concat(parts, ignore_index=True)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and `COUNTS` of each whole text, null counting as empty; rows that repeat come back as often."""
    return map_texts(df, id_col, text_col, dict.fromkeys(COUNTS, "bigint"), lambda texts: [c.to_numpy() for _, c in count(texts).items()])


def features(df: DataFrame) -> DataFrame:
    """Adds `FEATURES` to statistics."""
    return df.withColumns({name: F.expr(f"cast({e} as double)") for name, e in FEATURES.items()})


# learning


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.at_least else x[self.feature] < self.cut

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.cut if self.at_least else c < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """All conditions together say ``label``."""

    conditions: tuple[Condition, ...]
    label: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            hit &= c.holds(x)
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for c in self.conditions:
            hit = hit & c.column()
        return hit

    def __str__(self) -> str:
        return f"if {' and '.join(map(str, self.conditions)) or 'true'} then {self.label}"


@dataclass(frozen=True)
class DecisionList:
    """The first rule that holds decides; ``default`` where none does."""

    rules: tuple[Rule, ...]
    default: int

    def column(self) -> Column:
        """The label as one conditional expression over columns named as `FEATURES`; the rules in order."""
        if not self.rules:
            return F.lit(self.default)
        said = F
        for r in self.rules:
            said = said.when(r.column(), F.lit(r.label))
        return said.otherwise(F.lit(self.default))

    def decide(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(x.values()))), self.default)
        for r in reversed(self.rules):
            out[r.holds(x)] = r.label
        return out

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"else {self.default}"])


def cuts_of(values: np.ndarray, limit: int = CUTS) -> np.ndarray:
    """Thresholds between neighbouring values; if there are many, those at even shares of the rows."""
    distinct = np.unique(values)
    middle = (distinct[1:] + distinct[:-1]) / 2
    middle = np.where(middle > distinct[:-1], middle, distinct[1:])  # neighbours without a number between
    if len(middle) <= limit:
        return middle
    at = np.unique(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, limit + 2)[1:-1], method="nearest"), "left"))
    return middle[np.clip(at, 0, len(middle) - 1)]


def _information(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log2((p + 1e-9) / (p + n + 1e-9))


def grow(x: dict[str, np.ndarray], y: np.ndarray, label: int) -> Rule:
    """Adds the condition with the largest gain of information on the rows that the rule still covers, until it covers ``label`` only or nothing is gained.

    Thresholds come from the covered rows, so a long rule's are as fine as a short one's. Of equal gains the first feature and cut win.
    """
    covered = np.ones(len(y), bool)
    conditions: list[Condition] = []
    while len(conditions) < CONDITIONS and (y[covered] != label).any():
        good = y[covered] == label
        p0, n0 = good.sum(), (~good).sum()
        best, found = 1e-6, None
        for name in x:
            v = x[name][covered]
            cuts = cuts_of(v)
            if not len(cuts):
                continue
            order = np.argsort(v, kind="stable")
            below = np.searchsorted(v[order], cuts, "left")
            good_below = np.concatenate(([0], np.cumsum(good[order])))[below]
            for at_least in (True, False):
                p = p0 - good_below if at_least else good_below
                n = n0 - (below - good_below) if at_least else below - good_below
                gain = p * (_information(p, n) - _information(p0, n0))
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = float(gain[k]), Condition(name, at_least, float(cuts[k]))
        if found is None:
            break
        conditions.append(found)
        covered &= found.holds(x)
    return Rule(tuple(conditions), label)


def prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Drops conditions, one at a time, as long as that doesn't lower (right - wrong) / covered on rows that the rule wasn't grown on."""

    def worth(r: Rule) -> float:
        hit = r.holds(x)
        return (2 * np.count_nonzero(y[hit] == r.label) - hit.sum()) / hit.sum() if hit.any() else -1.0

    best = worth(rule)
    while len(rule.conditions) > 1:
        shorter = [Rule(rule.conditions[:i] + rule.conditions[i + 1 :], rule.label) for i in range(len(rule.conditions))]
        worths = [worth(r) for r in shorter]
        k = int(np.argmax(worths))
        if worths[k] < best:
            break
        rule, best = shorter[k], worths[k]
    return rule


def cover(x: dict[str, np.ndarray], y: np.ndarray, label: int = 0, precision: float = 0.8, seed: int = 11) -> DecisionList:
    """Sequential covering: rules for ``label`` one after the other, each grown on two thirds of the rows that are left and pruned on the
    rest, until a rule is right in less than ``precision`` of the rows it covers, or covers fewer than two; rows of other labels are the default.

    Without rows, or without rows of ``label``, there are no rules.
    """
    rules: list[Rule] = []
    default = 1 - label
    left = np.arange(len(y))
    draw = np.random.default_rng(seed)
    while len(rules) < RULES and (y[left] == label).any():
        parts = [draw.permutation(left[y[left] == k]) for k in (label, default)]  # both parts have rows of both labels
        used = np.sort(np.concatenate([p[: -(-2 * len(p) // 3)] for p in parts]))
        held = np.setdiff1d(left, used, assume_unique=True)
        at = lambda rows: ({k: v[rows] for k, v in x.items()}, y[rows])
        rule = grow(*at(used), label)
        if (y[held] == label).any():
            rule = prune(rule, *at(held))
        hit = rule.holds(x)[left]
        right = np.count_nonzero(y[left][hit] == label)
        if not rule.conditions or hit.sum() < 2 or right < precision * hit.sum():
            break
        rules.append(rule)
        left = left[~hit]
    return DecisionList(tuple(rules), default)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, precision: float = 0.8) -> DecisionList:
    """Rules for label 0 from at most ``sample`` labelled rows of ``stats`` (`features` of `statistics`).

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; rows with another or no label, or no id, aren't used; of several labels of an id the
    smallest counts). Labels of held-out rows (see `held_out`) are never read. Of rows that repeat an id, the smallest counts.
    """
    ids = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    ids = ids.groupBy(ids[id_col].alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    known = stats.select(stats[id_col].alias("id"), F.struct(*FEATURES).alias("x")).join(F.broadcast(ids), "id")
    # an id that repeats counts once, so the sample bounds this table
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("id", "y", "x.*").toPandas().sort_values("id", ignore_index=True)
    return cover({k: known[k].to_numpy(np.float64) for k in FEATURES}, known["y"].to_numpy(np.int64), precision=precision)


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in windows that repeat."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how: float) -> DataFrame:
    """``id_col, held_out``, `COUNTS`, ``base_failed`` and ``kept`` of each row: not failed by the fixed rules, and not rejected by the ones
    learned (see `learn`) from labelled rows that the fixed ones leave.

    Texts are read once; their statistics are written to the scratch folder. Null texts count as empty and fail; an empty table gives an
    empty one; without labels only the fixed rules decide.
    """
    stats = features(write_and_reread(statistics(df, id_col, text_col), "statistics"))
    rules = learn(stats.where(~base_failed()), labels, id_col, label_col, **how)
    kept = ~base_failed() & (rules.column() == 1)
    return stats.select(id_col, held_out(F.col(id_col)).alias("held_out"), *COUNTS, base_failed().alias("base_failed"), kept.alias("kept"))
