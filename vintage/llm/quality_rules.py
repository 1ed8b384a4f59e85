"""Quality rules: text statistics and decision lists learned from labels.

The learner is sequential covering: grow a conjunction of thresholds that
covers rejected rows by information gain, prune it on rows held back, accept
it if it is precise there, remove what it covers, repeat. The result is an
ordered list of readable rules that becomes one Spark CASE expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm import common

BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"

#: Labelled rows to learn from, at most; they reach the driver as a dozen numbers each.
TRAIN_ROWS = 20_000
WINDOW = 3

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_types")

#: Features of the learned rules, as SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "type_share": "n_types / greatest(n_words, 1)",
}


def text_statistics(text: bytes | None) -> tuple[int, ...]:
    """The STATISTICS of one text in UTF-8; all zero for null."""
    if not text:
        return (0,) * len(STATISTICS)
    words = text.split()
    without = lambda drop: len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen, upto = Counter(windows), 0
            for at, window in enumerate(windows):
                if seen[window] > 1:
                    repeated += at + WINDOW - max(at, upto)
                    upto = at + WINDOW
    return (
        len(words),
        without(BLANKS + CONTINUATION),
        len(text) - without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text) - without(UPPER),
        len(text) - without(DIGITS),
        text.count(b"!"),
        len(set(words)),
    )


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The keep columns of docs and the STATISTICS of its text, as longs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text"):
            found = [text_statistics(t) for t in common.byte_list(batch.column(0))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(k + 1) for k in range(len(keep))] + columns, [*keep, *STATISTICS])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{s} long" for s in STATISTICS])
    return common.map_batches(docs.select("text", *keep), rows, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, column: np.ndarray) -> np.ndarray:
        return column > self.threshold if self.above else column <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES.get(self.feature, self.feature)} {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for c in rule:
        mask &= c.holds(columns[c.feature])
    return mask


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the threshold of most FOIL gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and inside[~bad].any() and inside[bad].any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        base, best, gain = math.log2(p0 / (p0 + n0)), None, 1e-9
        for name, column in columns.items():
            values = np.unique(column[inside])
            if len(values) < 2:
                continue
            if len(values) > 65:
                values = np.unique(np.quantile(column[inside & bad], np.linspace(0, 1, 33)).tolist() + np.quantile(column[inside], np.linspace(0, 1, 33)).tolist())
            for cut in (values[1:] + values[:-1]) / 2:
                for above in (True, False):
                    mask = inside & (column > cut if above else column <= cut)
                    p, n = (mask & bad).sum(), (mask & ~bad).sum()
                    if p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(columns[best.feature])
    return tuple(rule)


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """Drop last conditions while (p - n) / (p + n) on the rows held back grows; with its precision and p."""
    best, value, precision, found = rule, -2.0, 0.0, 0
    for k in range(len(rule), 0, -1):
        mask = covers(rule[:k], columns, len(bad))
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        if p + n and (p - n) / (p + n) >= value:
            best, value, precision, found = rule[:k], (p - n) / (p + n), p / (p + n), p
    return best, precision, found


def learn(columns: dict[str, np.ndarray], good: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9) -> list[Rule]:
    """Ordered rules that reject; rows no rule covers are kept.

    A third of the rows prunes and judges the rules, by a fixed draw. Rows of
    one class, or none, give no rule.
    """
    bad = ~np.asarray(good, bool)
    held = np.random.default_rng(7).random(len(bad)) < 1 / 3
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = lambda mask: ({k: v[mask] for k, v in columns.items()}, bad[mask])
    while len(rules) < most_rules:
        grow, prune = part(left & ~held), part(left & held)
        if grow[1].sum() < 3 or not (~grow[1]).any():
            break
        rule = _grow(*grow, most_conditions)
        if not rule:
            break
        rule, precision, found = _prune(rule, *prune)
        if precision < least_precision or not found:
            break
        rules.append(rule)
        left &= ~covers(rule, columns, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects, as one CASE expression over the statistics."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(" AND ".join(f"({c.sql()})" for c in rule)), F.lit(False)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> list[str]:
    return [f"reject if {' and '.join(map(str, r))}" for r in rules] + ["else keep"]


def sampled(labels: DataFrame, rows: int) -> DataFrame:
    """At most rows rows, the same each time, chosen by a hash of the id."""
    n = labels.count()
    if n > rows:
        labels = labels.orderBy(F.xxhash64("doc_id"), *labels.columns).limit(rows)
    return labels


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from the statistics of at most rows labelled documents (doc_id, quality: 1 good, 0 bad); nulls are left out."""
    known = sampled(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality"), rows)
    # Broadcast: rows ids at most.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    frame = with_statistics(texts, "quality").selectExpr("quality", *(f"{sql} AS {name}" for name, sql in FEATURES.items())).toPandas()
    frame = frame.sort_values(list(frame.columns), ignore_index=True)
    return learn({name: frame[name].to_numpy(float) for name in FEATURES}, frame["quality"].to_numpy() == 1)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a document: doc_id, base statistics, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Repeated ids
    keep their rows; other columns of docs are ignored.
    """
    found = with_statistics(docs, "doc_id")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *STATISTICS[:5], failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(rules)).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return apply_rules(docs, train(docs, labels, rows))
