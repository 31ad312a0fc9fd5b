"""Toxicity: a chain of linear models over categories.

The models run in a fixed order. Each sees the words and shape of a text plus
the log-odds that the earlier models gave it; in training those come from
models that did not see the row (out of fold), so later models learn how far
earlier ones can be trusted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treatlens.llm.mixing import uniform
from treatlens.llm.tables import rows_of

#: Labelled rows that one chain is fitted on, on average.
SAMPLE_ROWS = 8_000
#: Words a chain looks at; each must show in so many sampled texts.
VOCABULARY, MIN_TEXTS = 256, 5
#: Least chi-square of a chosen word; chance words stay below.
LEAST_CHI = 16.0
SHAPE = ("symbols", "marks", "upper", "repeats", "length")
#: Word beginnings of these lengths count as words of their own, as inflected words share them.
STEMS = (4, 5, 6)
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def words_and_shape(text: str | None) -> tuple[set[str], list[float]]:
    """Distinct lower-case words and stems of the whole text and its ``SHAPE``; null counts as empty."""
    text = text or ""
    words = _LETTERS.findall(text.lower())
    distinct = set(words)
    stems = {w[:k] + "-" for k in STEMS for w in distinct if len(w) > k}
    n = max(1, len(text))
    return distinct | stems, [
        10 * sum(text.count(c) for c in "#*$%&|<>") / n,
        10 * (text.count("!") + text.count("?")) / n,
        len(_UPPER.findall(text)) / n,
        1 - len(distinct) / max(1, len(words)),
        float(np.log1p(len(words))) / 10,
    ]


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: tuple[np.ndarray, ...]  # words, shape, earlier log-odds, constant
    cuts: tuple[float, ...]  # probability from which a text counts as of the category

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = np.clip(np.hstack([x, out[:, :k], np.ones((len(x), 1))]) @ w, -30, 30)
        return out

    def matrix(self, texts: Sequence[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary) + len(SHAPE)), np.float32)
        known = self.vocabulary.keys()
        for i, text in enumerate(texts):
            words, shape = words_and_shape(text)
            for w in known & words:
                x[i, self.vocabulary[w]] = 1
            x[i, len(self.vocabulary) :] = shape
        return x


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps with a quadratic penalty (not on the constant)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        v = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), slope)
        w -= move * min(1.0, 4 / max(1e-12, float(np.abs(move).max())))
        if float(np.abs(move).max()) < 1e-4:
            break
    return w


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the classes with the highest F1, halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(np.argmax(f1))
    return float(p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str], vocabulary: dict[str, int]) -> Chain:
    """Fit the categories in order; ``folds`` numbers the rows' folds.

    What later models and the cuts see of a row comes from models fitted on the
    other folds.
    """
    weights, cuts = [], []
    seen = x
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        weights.append(fit_linear(seen, y))
        held = np.zeros(len(x))
        for fold in np.unique(folds):
            out = folds == fold
            w = fit_linear(seen[~out], y[~out]) if (~out).any() else weights[-1]
            held[out] = np.hstack([seen[out], np.ones((int(out.sum()), 1))]) @ w
        held = np.clip(held, -30, 30)
        cuts.append(best_cut(1 / (1 + np.exp(-held)), y))
        seen = np.hstack([seen, held[:, None]])
    return Chain(tuple(categories), vocabulary, tuple(weights), tuple(cuts))


def choose_words(doc: np.ndarray, word: np.ndarray, n_words: int, labels: np.ndarray) -> np.ndarray:
    """Numbers of the words that speak most for some category, by chi-square."""
    n = len(labels)
    df = np.bincount(word, minlength=n_words).astype(float)
    best = np.zeros(n_words)
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        hit = np.bincount(word, weights=y[doc], minlength=n_words)
        expected = df * y.mean()
        spread = np.maximum(expected * (1 - y.mean()) * (1 - df / n), 1e-9)
        best = np.maximum(best, np.where((df >= MIN_TEXTS) & (hit > expected), (hit - expected) ** 2 / spread, 0))
    order = np.argsort(-best, kind="stable")[:VOCABULARY]
    return order[best[order] >= LEAST_CHI]


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample_rows: int = SAMPLE_ROWS, n_folds: int = 4) -> Chain:
    """Fit a chain on labelled documents (doc_id, text) and 0/1 label columns.

    Rows with a null label are left out; several labels of one document count as
    their largest. Above ``sample_rows`` they are sampled by a hash of the id.
    Without labelled rows every probability is one half and no text counts.
    """
    held = labels.dropna(subset=list(categories)).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    total = held.count()
    if total > sample_rows:
        held = held.filter(uniform("doc_id") < sample_rows / total)
    # About sample_rows ids and their labels.
    rows = docs.select("doc_id", "text").join(F.broadcast(held), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [words_and_shape(t) for t in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sorted(w) for w, _ in got], pa.list_(pa.string())),
                    pa.array([s for _, s in got], pa.list_(pa.float64())),
                    *batch.columns[2:],
                ],
                names=["doc_id", "words", "shape", *categories],
            )

    kinds = ", ".join(f"`{c}` int" for c in categories)
    rows = rows.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in categories])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {id_type}, words array<string>, shape array<double>, {kinds}").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    y = np.column_stack([got[c].to_numpy() for c in categories]) if got.num_rows else np.zeros((0, len(categories)))
    if not got.num_rows:
        flat = tuple(np.zeros(len(SHAPE) + k + 1) for k in range(len(categories)))
        return Chain(tuple(categories), {}, flat, (1.0,) * len(categories))
    words = got["words"].combine_chunks()
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    doc, word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), coded.indices.to_numpy()
    chosen = choose_words(doc, word, len(coded.dictionary), y)
    vocabulary = {coded.dictionary[int(w)].as_py(): i for i, w in enumerate(chosen)}
    place = np.full(len(coded.dictionary), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sizes), len(chosen) + len(SHAPE)), np.float32)
    hit = place[word] >= 0
    x[doc[hit], place[word][hit]] = 1
    x[:, len(chosen) :] = got["shape"].combine_chunks().flatten().to_numpy().reshape(len(sizes), -1)
    return fit_chain(x, y, np.arange(len(x)) % n_folds, categories, vocabulary)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` with ``p_<category>`` and, for each, whether it reaches the chain's cut.

    Whole texts are read, a null text is empty. Repeated rows get equal scores;
    other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.matrix(rows_of(batch, "text"))
            p = 1 / (1 + np.exp(-model.value.log_odds(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *names]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rated = docs.select("doc_id", "text").mapInArrow(
        rate, f"doc_id {id_type}, " + ", ".join(f"`{n}` double" for n in names)
    )
    return rated.select("*", *[(F.col(f"p_{c}") >= cut).alias(c) for c, cut in zip(chain.categories, chain.cuts)])
