"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals.

Every text becomes a row of statistics. On labelled rows, rules for the bad
class are grown one threshold test at a time by information gain, pruned on
held-out rows, and the rows they cover are set aside before the next rule. The
list turns into one ordered ``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treatlens.llm.mixing import uniform
from treatlens.llm.tables import WORD, tidy

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_distinct",
)
#: Ratios the rules test: name -> (numerator, denominator).
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}
#: Labelled rows that one list is learned from, on average; they meet on the driver as a few numbers each.
SAMPLE_ROWS = 20_000
_WORD = re.compile(WORD)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list[str]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and distinct words."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(ids) < 3:
        return 0, len(seen)
    # Pairs are numbered first, so that a code never exceeds (number of words) squared.
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    code = pair[:-1].astype(np.int64) * len(seen) + ids[2:]
    _, where, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = n[where] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum()), len(seen)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """``STATS`` of one text; a null text counts as empty, all zero."""
    text = text or ""
    words = _WORD.findall(text)
    repeats, distinct = repeated_words(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(_UPPER.findall(text)),
        text.count("!") + text.count("?"),
        distinct,
    )


def with_statistics(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``docs`` with one long column per statistic, named with ``prefix``.

    Texts are read whole. Other columns pass through; those that bear the name
    of a statistic are refused (``keep_good`` takes any names).
    """
    taken = sorted({c.lower() for c in docs.columns} & {(prefix + s).lower() for s in STATS})
    if taken:
        raise ValueError(f"columns {', '.join(taken)} are taken; choose another prefix")
    fields = [T.StructField(prefix + s, T.LongType(), False) for s in STATS]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = [text_statistics(t.as_py()) for t in texts]
            stats = zip(*rows) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.int64()) for c in stats]],
                names=[*batch.schema.names, *[f.name for f in fields]],
            )

    return docs.mapInArrow(tidy(add), T.StructType([*docs.schema.fields, *fields]))


def base_failed(prefix: str = "_q_") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    words = F.col(prefix + "n_words")
    return (words < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * words)


def feature(name: str, prefix: str = "_q_") -> Column:
    top, bottom = FEATURES[name]
    return F.col(prefix + top).cast("double") / F.greatest(F.col(prefix + bottom), F.lit(1))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, prefix: str) -> Column:
        v = feature(self.feature, prefix)
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class RuleList:
    """Ordered conjunctions; the first that holds rejects, otherwise the text is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def rejecting_rule(self, prefix: str = "_q_") -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        chain = None
        for number, tests in enumerate(self.rules, 1):
            cond = tests[0].column(prefix)
            for test in tests[1:]:
                cond = cond & test.column(prefix)
            chain = F.when(cond, number) if chain is None else chain.when(cond, number)
        return out if chain is None else chain.otherwise(out)

    def rejects(self, x: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for tests in self.rules:
            out |= _covers(tests, x)
        return out

    def __str__(self) -> str:
        def one(t: Test) -> str:
            return f"{t.feature} {'>' if t.above else '<='} {t.threshold:g}"

        return "\n".join("reject if " + " and ".join(map(one, r)) for r in self.rules) + "\nelse keep"


def _covers(tests: tuple[Test, ...], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in tests:
        out &= t.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> tuple[Test, ...]:
    """Add the test of the highest information gain until no good row is covered."""
    tests: tuple[Test, ...] = ()
    inside = np.ones(len(x), bool)
    while len(tests) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        before, best, chosen = np.log2(p0 / (p0 + n0)), 1e-9, None
        for name, levels in cuts.items():
            values = x[name].to_numpy()[inside]
            of_bad = np.sort(values[bad[inside]])
            of_good = np.sort(values[~bad[inside]])
            low_p, low_n = np.searchsorted(of_bad, levels, "right"), np.searchsorted(of_good, levels, "right")
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, chosen = float(gain[k]), Test(name, above, float(levels[k]))
        if chosen is None:
            break
        tests += (chosen,)
        inside &= chosen.holds(x)
    return tests


def _prune(tests: tuple[Test, ...], x: pd.DataFrame, bad: np.ndarray) -> tuple[tuple[Test, ...], float, int]:
    """The prefix of the tests with the best (p - n) / (p + n) on held-out rows; its precision and reach."""
    best, kept, precision, reach = -2.0, tests, 0.0, 0
    for size in range(1, len(tests) + 1):
        inside = _covers(tests[:size], x)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept, precision, reach = worth, tests[:size], p / max(1, p + n), p
    return kept, precision, reach


def learn_rules(
    x: pd.DataFrame, bad: np.ndarray, min_precision: float = 0.95, min_reach: int = 3, most_rules: int = 24,
    most_tests: int = 4, levels: int = 64,
) -> RuleList:
    """Sequential covering over the feature columns of ``x``.

    Two thirds of the rows grow rules, one third prunes and judges them; a rule
    is kept if it rejects at least ``min_reach`` held-out bad rows with
    ``min_precision``. Learning stops at the first rule that fails. No rows, or
    rows of one class: an empty list, which rejects nothing.
    """
    order = np.random.default_rng(0).permutation(len(x))
    x, bad = x.iloc[order].reset_index(drop=True), np.asarray(bad, bool)[order]
    hold = np.arange(len(x)) % 3 == 0
    rules: list[tuple[Test, ...]] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (left & bad & ~hold).any():
        grow = left & ~hold
        cuts = {}
        for name in FEATURES:
            values = np.unique(np.quantile(x.loc[grow, name], np.linspace(0, 1, levels + 1)))
            cuts[name] = np.array([float(f"{v:.6g}") for v in (values[:-1] + values[1:]) / 2])
        tests = _grow(x[grow].reset_index(drop=True), bad[grow], {k: v for k, v in cuts.items() if len(v)}, most_tests)
        if not tests:
            break
        judged = left & hold
        tests, precision, reach = _prune(tests, x[judged].reset_index(drop=True), bad[judged])
        if precision < min_precision or reach < min_reach:
            break
        rules.append(tests)
        left &= ~_covers(tests, x)
    return RuleList(tuple(rules))


def fit_rules(
    stats: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, prefix: str = "_q_"
) -> RuleList:
    """Learn from labelled statistics (``doc_id`` and the prefixed columns); label 0 is bad.

    Rows that the base rules reject are left out, null labels too. A document
    with several labels takes the lowest. Above ``sample_rows`` labelled rows
    they are sampled by a hash of ``doc_id``.
    """
    held = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    names = [feature(f, prefix).alias(f) for f in FEATURES]
    rows = stats.filter(~base_failed(prefix)).join(held, "doc_id").select("doc_id", *names, "_label")
    total = rows.count()
    if total > sample_rows:
        rows = rows.filter(uniform("doc_id") < sample_rows / total)
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    return learn_rules(got[list(FEATURES)].astype(float), got["_label"].to_numpy() == 0)


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list rejects; columns as they were.

    Columns may have any names. Repeated rows are judged one by one.
    """
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rated = with_statistics(docs, prefix)
    rules = fit_rules(with_statistics(docs.select("doc_id", "text")).drop("text"), labels, sample_rows=sample_rows)
    return rated.filter(~base_failed(prefix) & rules.rejecting_rule(prefix).isNull()).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
