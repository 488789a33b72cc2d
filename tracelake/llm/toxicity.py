"""Toxicity: a convolutional text classifier with hashed word embeddings, trained by learners on Spark's partitions.

A word's embedding is the mean of hashed buckets: of the word and of its beginnings, so that words made from a known
stem are known too. Filters of several widths run over the words, the highest response of each filter is kept, and a
logistic layer weighs them. Thresholds are calibrated for each language that the text itself is recognised to be in.

As filters are linear, a worker keeps for each word its responses to every filter position; a text costs a look-up per
word, a few additions and a maximum.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.llm import langid
from tracelake.llm.hashing import Subwords, TokenRows, row_sums
from tracelake.llm.langid import TOKENS_AT_ONCE, words_of
from tracelake.llm.shared import batch_of, bounded_sample, fold_groups, release, slices, text_slices, written

BUCKET_BITS = 17
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
# Sizes of beginnings, with the mark before the word.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
EPOCHS, BATCH, RATE = 3, 24, 0.1
# A bucket needs so many texts before its share of toxic ones starts its embedding.
MIN_TEXTS = 3
# Rows of a learner, about, and the bytes of texts that it works on at a time.
LEARNER_ROWS = 8192
LEARNT_BYTES = 8 << 20
# Bits of the map that marks labelled ids, as a power of two.
MAP_BITS = 26
# Numbers of a model that are added up together.
BLOCK = 8192
# Steps of a score of 1 that thresholds tell apart.
SCORE_STEPS = 256
# One row of CALIBRATE sets thresholds and trains nothing.
CALIBRATE = 4
# A language with fewer toxic or other texts in the calibration takes the threshold of all.
LEAST_TEXTS = 8


@dataclass
class ToxicityModel:
    embeddings: np.ndarray
    filters: np.ndarray  # dimensions x (filter, place in it) of all widths
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float
    languages: langid.LanguageModel
    threshold: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """The tokens' responses at every filter place, then their rows of the language model."""
        found = Subwords(tokens, BUCKET_BITS, beginnings=BEGINNINGS)
        means = row_sums(self.embeddings[found.flat], found.sizes) / np.maximum(found.sizes, 1)[:, None]
        return np.concatenate([means @ self.filters, self.languages.token_rows(tokens)], axis=1, dtype=np.float32)

    def rows(self) -> TokenRows:
        return TokenRows(self.filters.shape[1] + len(self.languages.labels) + 1, self.token_rows)

    def logit(self, rows: TokenRows, tokens: list[str]) -> tuple[float, str]:
        """Of a whole text, and the language it is recognised to be in. Long texts go in overlapping parts."""
        places, overlap = self.filters.shape[1], max(WIDTHS) - 1
        pooled = np.full(len(self.weights), -np.inf)
        sums = np.zeros(len(self.languages.labels) + 1)
        for start in range(0, max(len(tokens), 1), TOKENS_AT_ONCE):
            found = rows.of(tokens[start : start + TOKENS_AT_ONCE + overlap])
            sums += found[:TOKENS_AT_ONCE, places:].sum(axis=0, dtype=np.float64)
            # Filters start at the part's own words; those that start behind them belong to the next part.
            own = TOKENS_AT_ONCE if start + TOKENS_AT_ONCE < len(tokens) else max(len(found), 1)
            responses = np.zeros((max(len(found), own) + overlap, places), np.float32)
            responses[: len(found)] = found[:, :places]
            pooled = np.maximum(pooled, _pooled(responses, self.filter_bias, own)[0])
        p = self.languages.probabilities(sums)
        language = "" if p is None else self.languages.labels[int(p.argmax())]
        return float(pooled @ self.weights + self.bias), language

    def scores(self, rows: TokenRows, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each whole text; 0.5 is the threshold of its language."""
        tokens = list(map(words_of, texts))
        rows.learn(set().union(*tokens))
        found = [self.logit(rows, t) for t in tokens]
        z = np.array([z - self.thresholds.get(language, self.threshold) for z, language in found])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _pooled(responses: np.ndarray, bias: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest response of each filter over the ``n`` words of a text, and the word it starts at."""
    best, where = [], []
    at = 0
    for width in WIDTHS:
        total = responses[:n, at : at + FILTERS].copy()
        for place in range(1, width):
            total += responses[place : n + place, at + place * FILTERS : at + (place + 1) * FILTERS]
        start = total.argmax(axis=0)
        best.append(total[start, np.arange(FILTERS)])
        where.append(start)
        at += width * FILTERS
    return np.concatenate(best) + bias, np.concatenate(where)


def _places() -> list[np.ndarray]:
    """Per place in a filter, the columns of all filters that have it and the filters' numbers."""
    out, at = [], 0
    for n, width in enumerate(WIDTHS):
        out.append(np.array([[at + place * FILTERS + f for f in range(FILTERS)] for place in range(width)]))
        at += width * FILTERS
    return out


def train(texts: list[str], toxic: list[int], languages: list[str | None], seed: int = 11) -> ToxicityModel:
    """A model of whole texts with labels 0 and 1. ``languages`` only train the recogniser of languages."""
    rng = np.random.default_rng(seed)
    named = [(t, lang) for t, lang in zip(texts, languages) if lang is not None]
    recogniser = langid.train([t for t, _ in named], [lang for _, lang in named]) if named else langid.train([], [])
    model = _new_model(recogniser, rng)
    words, sequences = langid.numbered(texts)
    subwords = Subwords(words, BUCKET_BITS, beginnings=BEGINNINGS)
    labels = np.array(toxic, np.int64)
    learned = [i for i in range(len(texts)) if i % CALIBRATE and len(sequences[i])]
    if not learned or len(set(labels[learned].tolist())) < 2:
        return _constant(model, labels.mean() if len(labels) else 0.0)
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for i in learned:
        seen[labels[i], np.unique(subwords.pick(np.unique(sequences[i]))[0])] += 1
    n = [int((labels[learned] == y).sum()) for y in (0, 1)]
    _start(model, seen, n)
    weight = {y: len(learned) / (2 * max(1, n[y])) for y in (0, 1)}
    sums = _first_sums(model)
    for epoch in range(EPOCHS):
        order = rng.permutation(learned)
        for begin in range(0, len(order), BATCH):
            _step(model, order[begin : begin + BATCH], sequences, labels, weight, subwords, sums)
    _calibrate(model, texts, labels)
    return model


def _new_model(languages: langid.LanguageModel, rng: np.random.Generator | None = None, seed: int = 11) -> ToxicityModel:
    rng = np.random.default_rng(seed) if rng is None else rng
    columns, n_filters = sum(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
    model = ToxicityModel(
        rng.normal(0, 0.01, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32),
        rng.normal(0, 0.3, (DIMENSIONS, columns)).astype(np.float32),
        np.zeros(n_filters, np.float32),
        np.full(n_filters, 0.1, np.float32),
        0.0,
        languages,
    )
    # One filter of each width starts as the evidence of its first word.
    for columns_of_width in _places():
        model.filters[:, columns_of_width[0][0]] = 0
        model.filters[0, columns_of_width[0][0]] = 1
    return model


def _constant(model: ToxicityModel, share: float) -> ToxicityModel:
    """The model for labels that are too few or all alike."""
    share = float(np.clip(share, 0.01, 0.99))
    model.weights[:], model.bias = 0, float(np.log(share / (1 - share)))
    return model


_TRAINED = ("embeddings", "filters", "filter_bias", "weights")


def _first_sums(model: ToxicityModel) -> dict[str, np.ndarray]:
    return {n: np.full(a.shape, 1e-4, np.float32) for n, a in vars(model).items() if n in _TRAINED}


def _start(model: ToxicityModel, seen: np.ndarray, texts: Sequence[float]) -> None:
    """Start the first dimension at the buckets' smoothed log-odds over texts: those that hold a bucket, and all."""
    n = [max(1, int(x)) for x in texts]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    model.embeddings[:, 0] = np.where(seen.sum(axis=0) >= MIN_TEXTS, np.clip(odds, -4, 6), 0)


def _step(model: ToxicityModel, batch, sequences, labels, weight, subwords: Subwords, sums) -> None:
    words, back = np.unique(np.concatenate([sequences[i] for i in batch]), return_inverse=True)
    ids, n_buckets = subwords.pick(words)
    embedded = row_sums(model.embeddings[ids], n_buckets) / np.maximum(n_buckets, 1, dtype=np.float32)[:, None]
    responses = embedded @ model.filters
    overlap = max(WIDTHS) - 1
    gradient = np.zeros_like(responses)
    pooled, picked, at = [], [], 0
    for i in batch:
        n = len(sequences[i])
        own = back[at : at + n]
        padded = np.zeros((n + overlap, responses.shape[1]), np.float32)
        padded[:n] = responses[own]
        best, where = _pooled(padded, model.filter_bias, n)
        pooled.append(best)
        picked.append((own, where))
        at += n
    pooled = np.array(pooled)
    y = labels[batch]
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    dz = ((p - y) * np.where(y == 1, weight[1], weight[0]) / len(batch)).astype(np.float32)
    d_pooled = dz[:, None] * model.weights
    for (own, where), d in zip(picked, d_pooled):
        first = 0
        for columns in _places():
            starts_at, d_width = where[first : first + FILTERS], d[first : first + FILTERS]
            for place, column in enumerate(columns):
                inside = starts_at + place < len(own)
                np.add.at(gradient, (own[starts_at[inside] + place], column[inside]), d_width[inside])
            first += FILTERS
    touched = np.flatnonzero(gradient.any(axis=1))
    d_embedded = (gradient[touched] @ model.filters.T) / np.maximum(n_buckets[touched], 1)[:, None]
    _descend(sums["filters"], model.filters, slice(None), embedded[touched].T @ gradient[touched])
    _descend(sums["filter_bias"], model.filter_bias, slice(None), d_pooled.sum(axis=0))
    _descend(sums["weights"], model.weights, slice(None), pooled.T @ dz)
    model.bias -= RATE * float(dz.sum())
    used, times = subwords.pick(words[touched])
    rows, at = np.unique(used, return_inverse=True)
    d_rows = np.zeros((len(rows), DIMENSIONS), np.float32)
    np.add.at(d_rows, at, np.repeat(d_embedded, times, axis=0))
    _descend(sums["embeddings"], model.embeddings, rows, d_rows)


def _descend(sums: np.ndarray, values: np.ndarray, at, gradient: np.ndarray) -> None:
    """One step with a rate that falls with the squares seen so far."""
    sums[at] += gradient**2
    values[at] -= RATE * gradient / np.sqrt(sums[at])


def _calibrate(model: ToxicityModel, texts: list[str], labels: np.ndarray) -> None:
    """Thresholds with the highest F1 on the held-back texts: of all, and of each language with enough texts."""
    rows, held = model.rows(), range(0, len(texts), CALIBRATE)
    tokens = {i: words_of(texts[i]) for i in held}
    rows.learn(set().union(*tokens.values()))
    found: dict[str, list[tuple[float, int]]] = {}
    for i in held:
        z, language = model.logit(rows, tokens[i])
        found.setdefault(language, []).append((z, labels[i]))
    every = [x for xs in found.values() for x in xs]
    model.threshold = _best_threshold(every)
    for language, xs in found.items():
        if min(sum(y for _, y in xs), sum(1 - y for _, y in xs)) >= LEAST_TEXTS:
            model.thresholds[language] = _best_threshold(xs)


def _best_threshold(scored: list[tuple[float, int]]) -> float:
    """Between the two scores where F1 is highest; the middle of several best places."""
    z = np.array([s for s, _ in scored])
    y = np.array([t for _, t in scored])
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if not y.any():
        return float(z.max(initial=0.0)) + 1.0
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cut = int(f1.argmax())
    below = z[cut + 1] if cut + 1 < len(z) else z[cut] - 2.0
    return float((z[cut] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> ToxicityModel:
    """Train on every labelled row with a text, whatever its length; ``sample_rows`` asks for so many of each class only.

    ``labels`` has doc_id and toxic. Rows without id or label are not used; a document labelled more than once counts with
    its highest label. The rows are dealt by a hash of their id, and a task is a learner. In each of ``EPOCHS`` rounds every
    learner goes through all of its rows from the parameters of the round before, and the next ones are the mean of all
    learners', by their numbers of rows. What the buckets start from and the thresholds are counted over all rows. Learners
    read some texts at a time; of the rows only sums of the model's size and counts come to the driver.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if sample_rows is not None:
        chosen = [bounded_sample(known.where(F.col("toxic") == y), sample_rows, ["doc_id"]) for y in (0, 1)]
        known = chosen[0].unionByName(chosen[1])
    known = written(spark, known.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "toxic-labels")
    learners = max(1, -(-known.count() // LEARNER_ROWS))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    usable = docs.where(F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang"))
    usable = _perhaps_in(usable, known).repartition(learners, "doc_id")
    mixed = F.xxhash64("doc_id", "text")
    rows = usable.join(known.repartition(learners, "doc_id"), "doc_id").select(
        mixed.alias("mixed"), (F.pmod(F.shiftright(mixed, 8), F.lit(CALIBRATE)) == 0).alias("held_back"), "toxic", "lang", "text"
    )
    # Coalesced, as every task that learns hands on a whole model.
    rows = written(spark, rows.sortWithinPartitions("mixed", "text"), "toxic-rows", "zstd").coalesce(learners)
    release(spark)
    names = sorted(r[0] for r in rows.select("lang").where(F.col("lang").isNotNull()).distinct().collect())
    model = _new_model(langid.new_model(names))
    counts = _summed(rows, _Counts)
    seen, found = counts[:-4].reshape(2, -1), counts[-4:]
    if not found[0] or not found[1]:
        return _constant(model, found[2] / found[3] if found[3] else 0.0)
    _start(model, seen, found[:2])
    weight = {y: float(found[0] + found[1]) / (2 * float(found[y])) for y in (0, 1)}
    sums = _first_sums(model)
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((model, sums))
        total = _summed(rows, lambda: _Learner(*state.value, weight, epoch))
        _set_parameters(model, sums, total[:-1] / total[-1])
        release(spark)
    _set_thresholds(rows, model)
    return model


def _perhaps_in(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose id is not in ``known``, so that their texts are not moved for the join.

    Ids are marked in a map of bits by a hash; an id that is known always passes.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    number, position = F.bitmap_bucket_number(place + 1), F.bitmap_bit_position(place + 1)
    found = known.groupBy(number.alias("number")).agg(F.bitmap_construct_agg(position).alias("bits")).collect()
    size = max((len(r.bits) for r in found), default=0)
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in found:
        bits[(r.number - 1) * size : r.number * size] = np.frombuffer(r.bits, np.uint8)
    shared, names = docs.sparkSession.sparkContext.broadcast(bits), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_place").to_numpy()
            marked = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield batch.select(names).filter(pa.array(marked))

    return docs.where(F.col("doc_id").isNotNull()).withColumn("_place", place).mapInArrow(run, docs.schema)


class _Counts:
    """Learnt texts of each class that hold a bucket; then learnt texts of each class, toxic rows and all."""

    def __init__(self) -> None:
        self.seen, self.found = np.zeros((2, 1 << BUCKET_BITS)), np.zeros(4)

    def learn(self, texts, toxic, languages, held_back) -> None:
        found, sequences = langid.numbered(texts)
        subwords = Subwords(found, BUCKET_BITS, beginnings=BEGINNINGS)
        for words, y, held in zip(sequences, toxic, held_back):
            self.found += (0, 0, y, 1)
            if len(words) and not held:
                self.found[y] += 1
                # A bucket that is named more than once counts once.
                self.seen[y, subwords.pick(np.unique(words))[0]] += 1

    def result(self) -> np.ndarray:
        return np.concatenate([self.seen.ravel(), self.found])


class _Learner:
    """One pass over rows; results in the parameters times the number of rows, and that number."""

    def __init__(self, model: ToxicityModel, sums: dict[str, np.ndarray], weight: dict[int, float], epoch: int) -> None:
        self.model, self.sums = pickle.loads(pickle.dumps((model, sums)))
        self.weight, self.epoch, self.rows = weight, epoch, 0
        self.rng = np.random.default_rng(epoch)

    def learn(self, texts, toxic, languages, held_back) -> None:
        self.rows += len(texts)
        words, sequences = langid.numbered(texts)
        subwords = Subwords(words, BUCKET_BITS, beginnings=BEGINNINGS)
        labels = np.array(toxic, np.int64)
        order = self.rng.permutation([i for i in range(len(texts)) if len(sequences[i]) and not held_back[i]]).astype(np.int64)
        for begin in range(0, len(order), BATCH):
            _step(self.model, order[begin : begin + BATCH], sequences, labels, self.weight, subwords, self.sums)
        named = [i for i, lang in enumerate(languages) if lang is not None]
        of = [languages[i] for i in named]
        langid.learn(self.model.languages, words, [sequences[i] for i in named], of, self.rng, langid.RATE / (1 + self.epoch))

    def result(self) -> np.ndarray:
        parts = [a.ravel() for a in _parameters(self.model, self.sums)]
        return np.concatenate([*parts, [self.model.bias], [1.0]]) * self.rows


def _parameters(model: ToxicityModel, sums: dict[str, np.ndarray]) -> list[np.ndarray]:
    """All that a round changes but the bias, in a fixed order. Squares of embeddings go by bucket."""
    own = [getattr(model, n) for n in _TRAINED] + [sums[n] for n in _TRAINED if n != "embeddings"]
    languages = model.languages
    return [*own, sums["embeddings"].mean(axis=1), languages.embeddings, languages.weights, languages.bias]


def _set_parameters(model: ToxicityModel, sums: dict[str, np.ndarray], values: np.ndarray) -> None:
    arrays = _parameters(model, sums)
    parts = np.split(values.astype(np.float32), np.cumsum([a.size for a in arrays]))
    for array, part in zip(arrays, parts):
        array[...] = part.reshape(array.shape)
    sums["embeddings"][...] = parts[len(arrays) - 4][:, None]
    model.bias = float(values[-1])


def _summed(rows: DataFrame, new: Callable[[], _Counts | _Learner]) -> np.ndarray:
    """The sum of what all learners result in, added up on Spark block by block. No rows sum to zeros.

    A task is a learner. Its last number tells of its rows.
    """
    schema = T.StructType.fromDDL("learner int, block int, data binary")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = new()
        for part in text_slices(batches, "text", LEARNT_BYTES):
            state.learn(*(part.column(n).to_pylist() for n in ("text", "toxic", "lang", "held_back")))
        values = state.result().astype(np.float32)
        learner = TaskContext.get().partitionId()
        # A learner without rows hands on nothing.
        for block, start in enumerate(range(0, len(values) if values[-1] else 0, BLOCK)):
            yield batch_of([(learner, block, values[start : start + BLOCK].tobytes())], kinds)

    made = rows.mapInArrow(run, schema)
    found = fold_groups(made, ["block"], ["learner"], ["data"], _Sum, "total binary").collect()
    if not found:
        return np.zeros(len(new().result()))
    return np.concatenate([np.frombuffer(r.total) for r in sorted(found, key=lambda r: r.block)])


class _Sum:
    """The sum of arrays."""

    def __init__(self) -> None:
        self.total: np.ndarray | float = 0.0

    def add(self, data: bytes) -> None:
        self.total = self.total + np.frombuffer(data, np.float32).astype(np.float64)

    def result(self) -> tuple:
        return (self.total.tobytes(),)


def _set_thresholds(rows: DataFrame, model: ToxicityModel) -> None:
    """Thresholds as ``_calibrate`` sets them, from counts of all held-back rows by steps of their scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = model.rows()
        for part in slices(batches):
            tokens = list(map(words_of, part.column("text").to_pylist()))
            known.learn(set().union(*tokens))
            found = [model.logit(known, t) for t in tokens]
            steps = np.clip(np.round([z * SCORE_STEPS for z, _ in found]), -(1 << 15), 1 << 15).astype(np.int32)
            columns = [pa.array([language for _, language in found], pa.string()), pa.array(steps), part.column("toxic")]
            yield pa.RecordBatch.from_arrays(columns, ["language", "step", "toxic"])

    scored = rows.where("held_back").select("text", "toxic").mapInArrow(run, "language string, step int, toxic int")
    counts = scored.groupBy("language", "step").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")
    ).collect()
    every, by_language = {}, {}
    for r in counts:
        for table in (every, by_language.setdefault(r.language, {})):
            toxic, other = table.get(r.step, (0, 0))
            table[r.step] = (toxic + r.toxic, other + r.other)
    model.threshold = _best_step(every)
    for language, table in by_language.items():
        if min(map(sum, zip(*table.values()))) >= LEAST_TEXTS:
            model.thresholds[language] = _best_step(table)


def _best_step(table: dict[int, tuple[int, int]]) -> float:
    """``_best_threshold`` of scores that are counted by steps."""
    if not table:
        return 0.0
    steps = np.array(sorted(table, reverse=True))
    toxic, other = np.array([table[s] for s in steps.tolist()], np.int64).T
    z = steps / SCORE_STEPS
    if not toxic.any():
        return float(z.max(initial=0.0)) + 1.0
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(toxic + other) + toxic.sum())
    cut = int(f1.argmax())
    below = z[cut + 1] if cut + 1 < len(z) else z[cut] - 2.0
    return float((z[cut] + below) / 2)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, 0 to 1: at 0.5 and more the text is past the threshold of the language it is recognised to be in.

    A null text counts as empty; texts without words get the score of the model for no words. Only ``text`` is looked
    at. A column named ``out`` is replaced, all others are kept, and rows keep their partition.
    """
    kept = [f for f in docs.schema.fields if f.name != out]
    names = [*(f.name for f in kept), out]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rows = model.rows()
        for part in slices(batches):
            column = pa.array(model.scores(rows, part.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), column], names)

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
