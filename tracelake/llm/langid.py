"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text is the mean of the embeddings of its subwords: each word with marks at both ends, and its character n-grams,
hashed into buckets. Training is stochastic gradient descent in numpy on a bounded sample. As the mean and the softmax's
input are linear, a worker keeps one small row per word it has seen, and a text costs one look-up per word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.hashing import Subwords, TokenRows, row_sums
from tracelake.llm.shared import bounded_sample, slices

BUCKET_BITS = 15
DIMENSIONS = 16
GRAMS = (2, 3)
EPOCHS, BATCH, RATE = 4, 32, 0.5
# A small sample is gone through more often, up to so many steps.
LEAST_STEPS = 300
# Rows a fit learns from, and the characters that a text of theirs may have.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
# Every CALIBRATE-th row of the sample sets temperature and rejection and trains nothing.
CALIBRATE = 5
MAX_ERROR = 0.01
UNKNOWN = "und"
TOKENS_AT_ONCE = 1 << 16


@dataclass
class LanguageModel:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """What each token adds to the sums before the softmax, and its number of subwords."""
        found = Subwords(tokens, BUCKET_BITS, GRAMS)
        sums = row_sums((self.embeddings @ self.weights)[found.flat], found.sizes)
        return np.concatenate([sums, found.sizes[:, None]], axis=1, dtype=np.float32)

    def probabilities(self, sums: np.ndarray) -> np.ndarray | None:
        """Of a text, from the sum of its tokens' rows; None if no token has a letter."""
        if not self.labels or sums[-1] == 0:
            return None
        z = (sums[:-1] / sums[-1] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def rows(self) -> TokenRows:
        return TokenRows(len(self.labels) + 1, self.token_rows)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def summed(rows: TokenRows, tokens: list[str]) -> np.ndarray:
    """The sum of the tokens' rows, a bounded number of tokens at a time."""
    total = np.zeros(rows.rows.shape[1])
    for start in range(0, len(tokens), TOKENS_AT_ONCE):
        total += rows.of(tokens[start : start + TOKENS_AT_ONCE]).sum(axis=0, dtype=np.float64)
    return total


def numbered(texts: Sequence[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of these texts, and every text as numbers of words."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = map(words_of, texts)
    sequences = [np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)) for found in words]
    return list(numbers), sequences


class Bags:
    """Numbered texts as counts of tokens, and the tokens' buckets."""

    def __init__(self, words: Sequence[str], sequences: Sequence[np.ndarray]) -> None:
        self.tokens, self.counts = [], []
        for sequence in sequences:
            tokens, counts = np.unique(sequence, return_counts=True)
            self.tokens.append(tokens)
            self.counts.append(counts)
        self.subwords = Subwords(words, BUCKET_BITS, GRAMS)

    def total(self, n: int) -> int:
        """The subwords of a text."""
        return int((self.subwords.sizes[self.tokens[n]] * self.counts[n]).sum())

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text, each once, and their shares of it."""
        found, sizes = self.subwords.pick(self.tokens[n])
        shares = np.bincount(found, np.repeat(self.counts[n], sizes))
        ids = np.flatnonzero(shares)
        return ids, (shares[ids] / shares.sum()).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """A model of whole texts. Every ``CALIBRATE``-th text sets temperature and rejection and trains nothing."""
    rng = np.random.default_rng(seed)
    model = new_model(sorted(set(labels)), rng)
    names = model.labels
    bags = Bags(*numbered(texts))
    known = [(*bags.buckets(n), names.index(label)) for n, label in enumerate(labels) if bags.total(n)]
    del bags
    learned = [b for n, b in enumerate(known) if n % CALIBRATE] or known
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(learned))))
    for epoch in range(epochs if learned else 0):
        order = rng.permutation(len(learned))
        for start in range(0, len(order), BATCH):
            rate = RATE * (1 - (epoch + start / len(order)) / epochs)
            np.add.at(model.embeddings, *_step(model, [learned[i] for i in order[start : start + BATCH]], rate))
    _calibrate(model, known[::CALIBRATE])
    return model


def new_model(names: list[str], rng: np.random.Generator | None = None, seed: int = 7) -> LanguageModel:
    """A model of these languages that has learnt nothing."""
    rng = np.random.default_rng(seed) if rng is None else rng
    embeddings = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(names)), np.float32)
    return LanguageModel(names, embeddings, weights, np.zeros(len(names), np.float32), 1.0, 0.0)


def learn(
    model: LanguageModel, words: Sequence[str], sequences: Sequence[np.ndarray], labels: Sequence[str], rng: np.random.Generator, rate: float
) -> None:
    """Go through these numbered texts once; their labels are among the model's."""
    numbers = {label: n for n, label in enumerate(model.labels)}
    bags = Bags(words, sequences)
    known = [(*bags.buckets(n), numbers[label]) for n, label in enumerate(labels) if bags.total(n)]
    order = rng.permutation(len(known))
    for start in range(0, len(order), BATCH):
        ids, change = _step(model, [known[i] for i in order[start : start + BATCH]], rate)
        # Changes of one bucket are summed before they are added, which takes a fraction of the time.
        by_id = np.argsort(ids, kind="stable")
        found, first = np.unique(ids[by_id], return_index=True)
        model.embeddings[found] += row_sums(change[by_id], np.diff([*first, len(ids)]))


def _step(model: LanguageModel, batch: list, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One step of the softmax; results in buckets and the changes that their embeddings are to get."""
    ids, part = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
    sizes = np.array([len(b[0]) for b in batch])
    means = row_sums(model.embeddings[ids] * part[:, None], sizes)
    z = means @ model.weights + model.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(batch)), [b[2] for b in batch]] -= 1
    back = p @ model.weights.T
    model.weights -= rate * (means.T @ p)
    model.bias -= rate * p.sum(axis=0) / len(batch)
    # A bucket's share of a text is small, so its rate is ten times as large.
    return ids, -10 * rate * np.repeat(back, sizes, axis=0) * part[:, None]


def _calibrate(model: LanguageModel, bags: list) -> None:
    """The temperature of the lowest loss, and the lowest bound that leaves few errors among accepted texts."""
    if not bags:
        return
    z = np.array([(model.embeddings[i] * p[:, None]).sum(axis=0) @ model.weights + model.bias for i, p, _ in bags])
    truth = np.array([b[2] for b in bags])

    def probabilities(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    def loss(temperature: float) -> float:
        return -np.log(probabilities(temperature)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.1, 20, 61), key=loss))
    p = probabilities(model.temperature)
    top, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    order = np.argsort(-top, kind="stable")
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= MAX_ERROR * np.arange(1, len(order) + 1))
    if not len(fine):
        model.reject_below = 1.0
    elif len(fine) < len(order) or fine[-1] < len(order) - 1:
        model.reject_below = float(top[order[fine[-1]]])


def fit(labelled: DataFrame, text: str, label: str, key: list[str], sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on at most ``sample_rows`` rows with a text of up to ``SAMPLE_CHARS`` characters and a label.

    The sample is the only thing the driver receives; its size does not grow with the table. Without such rows the
    model knows no language and calls every text unknown.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    rows = bounded_sample(usable.select(*{*key, text, label}), sample_rows, key).select(text, label).collect()
    return train([r[0] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (the calibrated probability of it) and ``rejected`` for each whole text.

    A null text, or one without a letter, is ``und`` with score 0, and rejected. Other texts get a learned language and
    are rejected if its probability is below the calibrated bound. Columns with these names are replaced, all others are
    kept; only ``text`` is looked at. Rows keep their partition.
    """
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in [*kept, *added]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = model.rows()
        for part in slices(batches):
            tokens = list(map(words_of, part.column(text).to_pylist()))
            rows.learn(set().union(*tokens))
            found = [_best(model, model.probabilities(summed(rows, t))) for t in tokens]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names)

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def _best(model: LanguageModel, p: np.ndarray | None) -> tuple[str, float, bool]:
    if p is None:
        return UNKNOWN, 0.0, True
    n = int(p.argmax())
    return model.labels[n], float(p[n]), bool(p[n] < model.reject_below)
