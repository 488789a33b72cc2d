"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The test items are indexed, and every passage of every document is a query. Postings are blocks by item number, and each
block keeps its highest impact. A passage is first bounded by the highest impact of each of its words, then by those of
the blocks it meets, and only items whose bound reaches the threshold are scored in full. Impacts are divided by the
score an item would give itself, so one threshold fits all items: the share of the item's own weight to be found.

The index is built in shards of a bounded number of items. A shard is broadcast and all documents pass it; more items
only mean more shards. Word statistics are those of all items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import slices

K1, B = 1.2, 0.75
# The share of an item's own weight that a passage has to hold, the shares of the word runs of its question and of its
# answer that the passage has to repeat.
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.5, 0.5
# The share of all word runs of an item that is enough without its answer, and the share that is if it has so many runs:
# as many as 13 words in a row have.
WHOLE_SHARE, LONG_SHARE, LONG_RUNS = 0.8, 0.5, 9
RUN_WORDS = 5
# Items in a shard of the index; least items in a block of postings, and numbers in the table of block bounds.
SHARD_ITEMS = 20_000
BLOCK_ITEMS = 4
BOUNDS = 1 << 23
WORDS = re.compile(r"[^\W_]+")
ASCII_WORDS = re.compile(r"[a-z0-9]+")
SENTENCE_END = re.compile(r"[.!?。！？]+\s+|\n+")
# The number of a word that no item has.
OTHER = -1


def words_in(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    text = text.lower()
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence that has any, and those of it; a single sentence is a question alone."""
    parts = [w for w in map(words_in, SENTENCE_END.split(text)) if w]
    if len(parts) < 2:
        return (parts or [[]])[0], []
    return [w for p in parts[:-1] for w in p], parts[-1]


def runs(words: list[str], most: int = RUN_WORDS) -> set[tuple[str, ...]]:
    n = min(most, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Statistics:
    """Of all items: their number, their mean number of words, and in how many of them a word is."""

    items: int
    mean_words: float
    frequency: dict[str, int]

    def impact(self, word: str, times: int, n_words: int) -> float:
        found = self.frequency[word]
        rarity = math.log(1 + (self.items - found + 0.5) / (found + 0.5))
        return rarity * times * (K1 + 1) / (times + K1 * (1 - B + B * n_words / self.mean_words))


class ItemIndex:
    """Postings of one shard of items, in blocks by item number, with impacts as shares of the items' own scores."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics, threshold: float) -> None:
        self.ids, self.threshold = [i for i, _ in items], threshold
        self.overlap = []
        postings: dict[str, list[tuple[int, float]]] = {}
        self.longest = 1
        for n, (_, text) in enumerate(items):
            words = words_in(text)
            self.longest = max(self.longest, len(words))
            question, answer = question_and_answer(text)
            # The answer by its words: one changed word changes every longer run of a short one.
            self.overlap.append((runs(question), runs(answer, 1), runs(words)))
            impacts = {w: statistics.impact(w, times, len(words)) for w, times in Counter(words).items()}
            own = sum(impacts.values())
            for word, impact in impacts.items():
                postings.setdefault(word, []).append((n, impact / own))
        self.terms = {word: n for n, word in enumerate(sorted(postings))}
        self.items = [[n for n, _ in postings[w]] for w in self.terms]
        self.impacts = [[s for _, s in postings[w]] for w in self.terms]
        self.highest = np.array([max(s) for s in self.impacts] + [0.0])
        # Highest impact per word and block of item numbers.
        self.block_items = max(BLOCK_ITEMS, math.ceil(len(items) * len(postings) / BOUNDS))
        self.bounds = np.zeros((len(postings), math.ceil(len(items) / self.block_items)), np.float32)
        for term, (item_numbers, impacts) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.bounds[term], np.array(item_numbers) // self.block_items, np.array(impacts, np.float32))

    @property
    def stride(self) -> int:
        """Passages are two strides long and start at each stride, so each run of up to a stride is inside one."""
        return self.longest

    def passages(self, codes: np.ndarray) -> np.ndarray:
        """Starts of the passages whose words' highest impacts reach the threshold."""
        # Repeated words count each time here; this bound is only ever too high.
        sums = np.concatenate([[0.0], np.cumsum(self.highest[codes])])
        starts = np.arange(0, max(1, len(codes) - self.stride), self.stride)
        bound = sums[np.minimum(starts + 2 * self.stride, len(codes))] - sums[starts]
        return starts[bound >= self.threshold - 1e-9]

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items with a score of at least the threshold, by block-max WAND over the distinct terms of a passage."""
        threshold = self.threshold - 1e-9
        # The bounds are rounded to short numbers.
        open_blocks = np.flatnonzero(self.bounds[terms].sum(axis=0) >= threshold - 1e-4).tolist()
        if not open_blocks:
            return []
        found = []
        # Cursors: [next item, place in the postings, term].
        cursors = [[self.items[t][0], 0, t] for t in terms.tolist()]
        none = 1 << 62
        for block in open_blocks:
            first, last = block * self.block_items, (block + 1) * self.block_items
            for c in cursors:
                if c[0] < first:
                    c[1] = bisect_left(self.items[c[2]], first, c[1])
                    c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else none
            inside = [c for c in cursors if c[0] < last]
            while inside:
                inside.sort()
                # The pivot: the first item whose words so far could reach the threshold together.
                total, pivot = 0.0, None
                for c in inside:
                    total += self.highest[c[2]]
                    if total >= threshold:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if inside[0][0] == pivot:
                    score = 0.0
                    for c in inside:
                        if c[0] != pivot:
                            break
                        score += self.impacts[c[2]][c[1]]
                    if score >= threshold:
                        found.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
                for c in inside:
                    if c[0] < target:
                        c[1] = bisect_left(self.items[c[2]], target, c[1])
                        c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else none
                inside = [c for c in inside if c[0] < last]
        return found

    def leaks(self, text: str) -> list[tuple[int, float, float, float]]:
        """(item id, score, question share, answer share) of the items found in a text, each by its best passage."""
        words = words_in(text)
        codes = np.fromiter(map(self.terms.get, words, repeat(OTHER)), np.int64, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        for start in self.passages(codes).tolist():
            passage = codes[start : start + 2 * self.stride]
            found = self.search(np.unique(passage[passage >= 0]))
            if not found:
                continue
            seen: dict[int, set[tuple[str, ...]]] = {}
            own = words[start : start + 2 * self.stride]
            for item, score in found:
                shares = [_share(part, own, seen) for part in self.overlap[item]]
                long = shares[2] >= LONG_SHARE and shares[2] * len(self.overlap[item][2]) >= LONG_RUNS - 1e-9
                both = shares[0] >= QUESTION_SHARE and shares[1] >= ANSWER_SHARE
                if both or long or shares[2] >= WHOLE_SHARE:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, *shares[:2]))
        return [(self.ids[item], *values) for item, values in sorted(best.items())]


def _share(part: set[tuple[str, ...]], words: list[str], seen: dict[int, set[tuple[str, ...]]]) -> float:
    """The share of the word runs that the passage repeats; 1 for no runs."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in seen:
        seen[n] = set(zip(*(words[i:] for i in range(n))))
    return len(part & seen[n]) / len(part)


def item_words(items: DataFrame, text: str) -> DataFrame:
    """(words): the words of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [words_in(x) for x in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string()))], ["words"])

    return items.select(text).mapInArrow(run, "words array<string>").where(F.size("words") > 0)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(``doc_id``, ``item_id``, score, question_share, answer_share): each test item that a document repeats.

    Words are runs of letters and digits, lower-cased. An item is found in a passage if the passage holds at least
    ``threshold`` of the item's own BM25 weight, and repeats at least half of the word runs of its question and half of
    the words of its answer, which is its last sentence. As the last sentence need not be an answer, half of all runs of
    the item are enough if they are at least ``LONG_RUNS``, and ``WHOLE_SHARE`` of them always. Documents with null or empty texts, and items without words, take
    no part; repeated items are all found. Rows that repeat a document give their rows again. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    usable = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    words = item_words(usable, item_text)
    about = words.agg(F.count(F.lit(1)).alias("items"), F.avg(F.size("words")).alias("mean")).first()
    per_word = words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    shards = max(1, math.ceil(about["items"] / SHARD_ITEMS))
    parts = []
    for shard in range(shards):
        own = usable.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(shards)) == shard)
        rows = own.select(F.col(item_id).cast("long"), item_text).collect()
        pairs = sorted((int(i), t) for i, t in rows if words_in(t))
        if not pairs:
            continue
        used = {w for _, t in pairs for w in words_in(t)}
        # Only the shard's own words reach the driver.
        asked = F.broadcast(spark.createDataFrame([(w,) for w in sorted(used)], "word string"))
        frequency = {r[0]: r[1] for r in per_word.join(asked, "word").collect()}
        index = ItemIndex(pairs, Statistics(about["items"], about["mean"], frequency), threshold)
        parts.append(_search(docs, index, doc_id, text))
    if not parts:
        kind = docs.schema[doc_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{doc_id}` {kind}, item_id long, score double, question_share double, answer_share double")
    return reduce(DataFrame.unionByName, parts)


def _search(docs: DataFrame, index: ItemIndex, doc_id: str, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [doc_id, "item_id", "score", "question_share", "answer_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in slices(batches):
            at, out = [], []
            for n, x in enumerate(part.column(text).to_pylist()):
                found = index.leaks(x) if x else []
                at += [n] * len(found)
                out += found
            columns = [pa.array([f[c] for f in out], k) for c, k in enumerate((pa.int64(), *[pa.float64()] * 3))]
            yield pa.RecordBatch.from_arrays([part.column(doc_id).take(pa.array(at, pa.int64())), *columns], names)

    schema = f"`{doc_id}` {kind}, item_id long, score double, question_share double, answer_share double"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, leaks: DataFrame, ids_sent: int, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in no row of ``leaks``. Up to ``ids_sent`` ids go to every task."""
    gone = leaks.select(F.struct(F.col(doc_id).alias("doc")).alias("_doc")).distinct()
    gone = F.broadcast(gone) if gone.count() <= ids_sent else gone
    keyed = docs.withColumn("_doc", F.struct(F.col(doc_id).alias("doc")))
    return keyed.join(gone, "_doc", "left_anti").select(*docs.columns)
