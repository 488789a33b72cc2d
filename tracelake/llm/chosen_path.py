"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, and sets that are equal are one from the start. Independent trees branch the
sets: a node picks one or two places of a minwise signature, 4/3 on average, and sends each set to the child that its
token there names, so two sets stay together with their similarity. Nodes of up to ``LEAF`` sets are compared in full,
and all nodes once that costs no more than in proportion to the table. Larger ones branch on, and the deeper they go the more pairs are parted in all trees of a forest, which share the places
of one signature. ``missed`` is that share at the similarity asked for: with twelve trees and a similarity of 3/4 it is
7 in a million after two levels, 1.3 in 10,000 after three and 4.9 % after eleven. So the sets of nodes that branch on
beyond what ``MISSED`` allows go through more forests, each on a signature of its own, until the product of the shares
at the levels that were reached is below it.

Near copies of one document would stay together for many levels. So the sets of a first node, and of every node that is
large, are compared with one set in it before it branches. What these links connect is one component already: its
sets are not compared with each other, and a node whose sets are all of one component is done. Every link is confirmed on
the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.components import components
from tracelake.llm.line_dedup import text_key
from tracelake.llm.merging import Remembered
from tracelake.llm.shared import UPPER, hand_back, release, slices, written

SHINGLE_WORDS = 5
PERCENT = 75
TREES = 12
# The share of the pairs at the similarity asked for that the trees may miss.
MISSED = 2e-5
# Places of the signature that trees branch on, and places that sketches are compared on.
BRANCH_PLACES, SKETCH_PLACES = 64, 128
# Nodes with up to so many sets outside their largest component are compared in full; after so many levels larger ones
# are too, in blocks. A comparison of sketches costs less than moving a set through another level, and loses no pair.
LEAF, LEVELS = 256, 10
# Larger nodes are compared so as well, in blocks, once a set of the table meets only so many times ``LEAF`` others by it on
# average. A node that grows with the table branches on instead.
MET = 4
# Nodes with up to so many sets have a star around one of them.
SMALL = 32
# Up to this level large nodes are compared with about so many of their sets first.
FIRSTS_LEVEL, FIRSTS = 1, 4
# Nodes draw these sets by one of so many hashes, so that trees ask for the same pairs.
DRAWS = 4
# Sketches have to agree on so many percent less than the similarity asked for: four standard deviations of the
# estimate.
SKETCH_SLACK = 15
# Up to so many ids are sent to every task, rather than moving all texts to them.
IDS_SENT = 500_000
KEY = ["s1", "s2"]
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
HASHES_AT_ONCE = 4096
# What a task holds at a time: pairs of sketches, and shingles of a block of whole sets.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 16, 1 << 17


class Shingler:
    """Sets of word shingles as sorted 64-bit numbers, and their minwise signatures."""

    def __init__(self, words: int = SHINGLE_WORDS, seed: int = 5, forest: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.words = words
        self.factors = rng.integers(1, 1 << 62, words + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = rng.integers(1, 1 << 62, SKETCH_PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if forest:
            own = np.random.default_rng([seed, forest])
            self.places = own.integers(1, 1 << 62, BRANCH_PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.word = Remembered(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"))

    def shingles(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles of a text; with fewer words than a shingle has, all words are one."""
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        n = min(len(h), self.words)
        total = np.full(len(h) - n + 1, np.uint64(n) * self.factors[-1], np.uint64)
        for place in range(n):
            total += h[place : len(h) - n + 1 + place] * self.factors[place]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0x9E3779B97F4A7C15)
        return np.unique(total)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest product with each place's factor: the minwise token of the place."""
        least = np.full(len(self.places), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(shingles), HASHES_AT_ONCE):
            products = shingles[start : start + HASHES_AT_ONCE, None] * self.places
            np.minimum(least, products.min(axis=0), out=least)
        return least >> np.uint64(32)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: id, text key, set size, set key (s1, s2), signature and sketch. Rows without words have no set key."""
    schema = T.StructType(
        [
            T.StructField("doc", T.LongType()),
            T.StructField("text_key", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("s1", T.LongType()),
            T.StructField("s2", T.LongType()),
            T.StructField("signature", T.BinaryType()),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"),
        text_key(F.col(text)).alias("text_key"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        shingler = Shingler()
        for part in slices(batches):
            out = []
            for raw in part.column("text").to_pylist():
                found = shingler.shingles(raw)
                if not len(found):
                    out.append((0, None, None, None, None))
                    continue
                tokens = shingler.signature(found)
                s1, s2 = _key_of(found)
                signature = tokens[:BRANCH_PLACES].astype(">u4").tobytes()
                out.append((len(found), s1, s2, signature, tokens.astype(np.uint8).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text_key"), *columns], schema.names)

    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row with words: set key (s1, s2) and the whole set as an array of longs."""
    schema = "s1 long, s2 long, shingles array<long>"
    rows = docs.select(F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in slices(batches):
            found = [x for x in map(shingler.shingles, part.column("text").to_pylist()) if len(x)]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())
            arrays = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(arrays, ["s1", "s2", "shingles"])

    return rows.mapInArrow(run, schema)


def _key_of(shingles: np.ndarray) -> tuple[int, int]:
    """The set key."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))


def signatures(docs: DataFrame, text: str, forest: int) -> DataFrame:
    """Per row with words: set key (s1, s2), set size and the signature that the trees of a later forest branch on."""
    rows = docs.select(F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(forest=forest)
        for part in slices(batches):
            found = [x for x in map(shingler.shingles, part.column("text").to_pylist()) if len(x)]
            keys = np.array([_key_of(x) for x in found], np.int64).reshape(-1, 2)
            tokens = [shingler.signature(x).astype(">u4").tobytes() for x in found]
            sizes = pa.array([len(x) for x in found], pa.int64())
            arrays = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), sizes, pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "n", "signature"])

    return rows.mapInArrow(run, "s1 long, s2 long, n long, signature binary")


def token_at(place: Column) -> Column:
    """The minwise token at a place of the signature."""
    return F.substring(F.col("signature"), place * 4 + 1, F.lit(4))


def missed(levels: int, percent: int, trees: int) -> float:
    """The share of the pairs of a similarity that no tree of a forest keeps together for so many levels.

    All trees see the same places, so the number of places in which a pair agrees is drawn once for all of them.
    """
    roots, total = trees + trees // 3, 0.0
    for agree in range(BRANCH_PLACES + 1):
        share, together = agree / BRANCH_PLACES, 1.0
        for _ in range(levels - 1):
            parted = 1 - share * together
            together = 1 - parted * (2 + parted) / 3
        chance = math.comb(BRANCH_PLACES, agree) * (percent / 100) ** agree * (1 - percent / 100) ** (BRANCH_PLACES - agree)
        total += chance * (1 - share * together) ** roots
    return total


def first_nodes(sets: DataFrame, trees: int) -> DataFrame:
    """(node, s1, s2, n): the children of each tree's root. Every third tree picks two places, the others one."""
    places, place = [], 0
    for tree in range(trees):
        for _ in range(2 if tree % 3 == 2 else 1):
            places.append((tree, place % BRANCH_PLACES))
            place += 1
    nodes = F.array(*(F.xxhash64(F.lit(t), F.lit(p), token_at(F.lit(p))) for t, p in places))
    return sets.select(F.explode(nodes).alias("node"), *KEY, "n")


def next_nodes(rows: DataFrame) -> DataFrame:
    """The children of nodes: a hash of the node picks one place, or with one chance in three two."""
    places = [F.pmod(F.xxhash64(F.lit(n), F.col("node")), F.lit(BRANCH_PLACES)).cast("int") for n in (1, 2)]
    child = [F.xxhash64("node", p, token_at(p)) for p in places]
    two = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.lit(3)) == 0
    children = F.array_distinct(F.when(two, F.array(*child)).otherwise(F.array(child[0])))
    return rows.select(F.explode(children).alias("node"), *KEY, "n")


def agreeing(pairs: DataFrame, percent: int, slack: int = SKETCH_SLACK) -> DataFrame:
    """The pairs (a1, a2, b1, b2) whose sketches agree nearly enough, and whose sizes allow the similarity."""
    least = (percent - slack) / 100
    sized = pairs.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    names = ["a1", "a2", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_PLACES)
                for c in ("a_sketch", "b_sketch")
            )
            near = np.flatnonzero((a == b).mean(axis=1) >= least)
            yield batch.select(names).take(pa.array(near))

    return sized.select(*names, "a_sketch", "b_sketch").mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _renamed(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(
        F.col("s1").alias(f"{side}1"),
        F.col("s2").alias(f"{side}2"),
        F.col("n").alias(f"{side}_n"),
        F.col("sketch").alias(f"{side}_sketch"),
    )


def near_the_first(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each set in a node with a few first sets in it, if they are of different components.

    They only save comparisons later, so sketches have to agree in full. The first is the smallest set in a small node,
    so that a pair is met in many nodes and confirmed once. In a large node a hash chooses about ``FIRSTS`` sets, by one
    of ``DRAWS`` hashes for each node: stars around many sets soon make one component of those that are one, and a set meets
    much the same ones in all nodes of a draw.
    """
    smallest = nodes.where(F.col("_sets") <= SMALL).groupBy("node").agg(F.min("s1").alias("s1"))
    drawn = F.pmod(F.xxhash64(F.pmod("node", F.lit(DRAWS)), *KEY), F.lit(1 << 32))
    chosen = (F.col("_sets") > SMALL) & (drawn * F.col("_sets") < FIRSTS << 32)
    firsts = nodes.where(chosen).unionByName(nodes.join(smallest, ["node", "s1"], "left_semi"))
    names = zip((*KEY, "l1", "l2", "n"), ("b1", "b2", "_l1", "_l2", "_n"))
    pairs = nodes.join(firsts.select("node", *(F.col(c).alias(n) for c, n in names)), "node").where("l1 <> _l1 or l2 <> _l2")
    # Sizes rule most pairs out before the sketches are moved.
    pairs = pairs.where(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))
    pairs = pairs.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), "b1", "b2")
    # A set gets its sketch once for all that it meets.
    met = pairs.groupBy("a1", "a2").agg(F.collect_set(F.struct("b1", "b2")).alias("_met")).join(_renamed(sets, "a"), ["a1", "a2"])
    pairs = met.select("*", F.inline("_met")).join(_renamed(sets, "b"), ["b1", "b2"])
    return agreeing(pairs, percent, slack=0)


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """``mixed`` while every set is a component of its own: the nodes with several sets."""
    several = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1")
    own = [F.col("s1").alias("l1"), F.col("s2").alias("l2"), "_sets", (F.col("_sets") - 1).alias("_others")]
    return nodes.join(several, "node").select("node", *KEY, "n", *own, F.lit(False).alias("_main"))


def narrowed(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The signatures of the sets in ``rows``, written, so that no deeper level moves those of the others."""
    keys = rows.select(*KEY).distinct()
    keys = F.broadcast(keys) if keys.count() <= IDS_SENT else keys
    return written(members.sparkSession, members.select(*KEY, "signature").join(keys, KEY, "left_semi"), "open-signatures")


def mixed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, s1, s2, l1, l2, _sets, _others, _main): the nodes that hold sets of different components.

    ``_others`` is the number of sets outside the node's largest component, ``_main`` tells whether a set is inside.
    """
    labelled = nodes.join(labels, KEY)
    counts = labelled.groupBy("node", "l1", "l2").agg(F.count(F.lit(1)).alias("_n"))
    # Of equally large components any one may be the main one; the order makes it one of them.
    order = F.col("_n") * (1 << 20) + F.pmod(F.xxhash64("l1", "l2"), F.lit(1 << 20))
    about = counts.groupBy("node").agg(
        F.sum("_n").alias("_sets"),
        F.max("_n").alias("_most"),
        F.max_by("l1", order).alias("_l1"),
        F.max_by("l2", order).alias("_l2"),
    )
    several = about.where("_sets > _most").withColumn("_others", F.col("_sets") - F.col("_most")).drop("_most")
    main = (F.col("l1") == F.col("_l1")) & (F.col("l2") == F.col("_l2"))
    return labelled.join(several, "node").withColumn("_main", main).drop("_l1", "_l2")


def _with_texts(keys: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The sets of some keys with the document that each is read from, and the rows of these documents."""
    wanted = sets.select(*KEY, F.col("doc").alias("_doc")).join(keys, KEY, "left_semi")
    wanted = written(keys.sparkSession, wanted, "wanted-sets")
    ids = wanted.select("_doc").distinct()
    # A bounded list goes to the texts; a longer one meets them in a shuffle.
    ids = F.broadcast(ids) if ids.count() <= IDS_SENT else ids
    return wanted, docs.join(ids, docs[doc_id].cast("long").eqNullSafe(F.col("_doc")), "left_semi")


def _whole_sets(keys: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(s1, s2, shingles): the whole sets of some keys, written."""
    wanted, texts = _with_texts(keys, sets, docs, doc_id)
    found = shingle_sets(texts, doc_id, text).join(wanted.select(*KEY), KEY, "left_semi")
    # Rows that repeat an id and a text give their set once.
    found = found.groupBy(*KEY).agg(F.first("shingles").alias("shingles"))
    return written(keys.sparkSession, found, "whole-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity: 100 * common >= percent * all."""
    ends = pairs.select(F.col("a1").alias("s1"), F.col("a2").alias("s2")).unionByName(
        pairs.select(F.col("b1").alias("s1"), F.col("b2").alias("s2"))
    )
    found = _whole_sets(ends.distinct(), sets, docs, doc_id, text)
    a, b = (
        found.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("shingles").alias(f"{x}_set"))
        for x in "ab"
    )
    common = F.size(F.array_intersect("a_set", "b_set"))
    met = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    every = F.size("a_set") + F.size("b_set") - common
    return met.where(100 * common >= percent * every).select("a1", "a2", "b1", "b2")


def _lists(leaves: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, pa.StructArray | None]]:
    """Each row's node, ``members`` and ``block``."""
    for row in range(leaves.num_rows):
        members, block = (leaves.column(c)[row].values for c in ("members", "block"))
        yield leaves.column("node")[row].as_py(), members, block


def _may_be_near(node: int, a: pa.StructArray, b: pa.StructArray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of two lists, or of one, of different components that agree nearly enough by sizes and sketches.

    Sets that stay together are in many nodes together; the smallest of them gives the pair. Of one list, each pair comes once.
    """
    one, b = b is None, a if b is None else b
    (l1, l2, n), (m1, m2, m) = ([x.field(c).to_numpy() for c in ("l1", "l2", "n")] for x in (a, b))
    fits = (l1[:, None] != m1) | (l2[:, None] != m2)
    fits &= 100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m)
    i, j = np.nonzero(np.triu(fits, 1) if one else fits)
    if not len(i):
        return i, j
    ka, kb = (np.frombuffer(b"".join(x.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH_PLACES) for x in (a, b))
    near = np.zeros(len(i), bool)
    for start in range(0, len(i), PAIRS_AT_ONCE):
        some = slice(start, start + PAIRS_AT_ONCE)
        near[some] = (ka[i[some]] == kb[j[some]]).mean(axis=1) >= (percent - SKETCH_SLACK) / 100
    i, j = i[near], j[near]
    smaller, others = (
        {p: {n for n in x.field("nodes")[p].as_py() if n < node} for p in np.unique(ps).tolist()} for x, ps in ((a, i), (b, j))
    )
    first = np.array([smaller[p].isdisjoint(others[q]) for p, q in zip(i.tolist(), j.tolist())], bool)
    return i[first], j[first]


def sets_met(leaves: DataFrame, percent: int) -> DataFrame:
    """(node, s1, s2, n): the sets of lists that have to be compared in full with another one of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = [np.zeros((4, 0), np.int64)]
            for node, a, b in _lists(part):
                i, j = _may_be_near(node, a, b, percent)
                ends = [(a, np.concatenate([i, j]))] if b is None else [(a, i), (b, j)]
                for members, at in ends if len(i) else ():
                    at = np.unique(at)
                    out.append(np.stack([np.full(len(at), node), *(members.field(c).to_numpy()[at] for c in (*KEY, "n"))]))
            columns = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", *KEY, "n"])

    return leaves.select("node", "members", "block").mapInArrow(run, "node long, s1 long, s2 long, n long")


def in_one_leaf(leaves: DataFrame, percent: int) -> DataFrame:
    """The links between the sets of different components among ``members``, or between those and ``block``.

    Pairs are compared where their sets are, in full, as many more are looked at than are links.
    """

    def linked(node: int, a: pa.StructArray, b: pa.StructArray | None) -> Iterator[tuple[int, int]]:
        i, j = _may_be_near(node, a, b, percent)
        if not len(i):
            return
        lists = [x.field("shingles") for x in ((a,) if b is None else (a, b))]
        sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists])
        ids = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        sets = [ids[end - size : end] for size, end in zip(sizes.tolist(), ends.tolist())]
        marked, before = np.zeros(len(ids), bool), -1
        for p, q in zip(i.tolist(), (j if b is None else j + len(a)).tolist()):
            if p != before:
                if before >= 0:
                    marked[sets[before]] = False
                marked[sets[p]], before = True, p
            common = np.count_nonzero(marked[sets[q]])
            if 100 * common >= percent * (len(sets[p]) + len(sets[q]) - common):
                yield p, q if b is None else q - len(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for node, a, b in _lists(part):
                keys = [list(zip(*(x.field(c).to_pylist() for c in KEY))) for x in (a, a if b is None else b)]
                for p, q in linked(node, a, b):
                    x, y = keys[0][p], keys[1][q]
                    out.append((*min(x, y), *max(x, y)))
            columns = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, n]) for n in range(4)], ["a1", "a2", "b1", "b2"])

    return leaves.select("node", "members", "block").mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def _as_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("a1").alias("u1"), F.col("a2").alias("u2"), F.col("b1").alias("v1"), F.col("b2").alias("v2")
    )


def _labels(sets: DataFrame, known: DataFrame | None) -> DataFrame:
    """(s1, s2, l1, l2): the smallest set of the component that each set is known to be in."""
    if known is None:
        return sets.select(*KEY, F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    return sets.select(*KEY).join(known.toDF(*KEY, "l1", "l2"), KEY, "left").select(
        *KEY, F.coalesce("l1", "s1").alias("l1"), F.coalesce("l2", "s2").alias("l2")
    )


def _met_in_blocks(nodes: DataFrame) -> int:
    """How many sets those outside the largest component of large nodes would meet in blocks, together."""
    rows = nodes.where((F.col("_others") > LEAF) & ~F.col("_main"))
    return rows.agg(F.coalesce(F.sum("_sets"), F.lit(0))).first()[0]


def _in_blocks(rows: DataFrame, own: Column, block: Column, label: str) -> DataFrame:
    """(node, members, block): blocks of a node's sets, each with itself and with every block before it.

    ``own`` is the number of blocks that are compared at all: those behind them only meet them.
    """
    rows = rows.withColumns({"_own": own.cast("int"), "_block": block.cast("int")})
    members = F.struct(*(c for c in (*KEY, "l1", "l2", "n", "sketch", "nodes", "shingles") if c in rows.columns))
    lists = rows.groupBy("node", "_own", "_block").agg(F.collect_list(members).alias("members"))
    lists = written(rows.sparkSession, lists, label)
    first = lists.where("_block < _own")
    alone = first.select("node", "members", F.lit(None).cast(lists.schema["members"].dataType).alias("block"))
    asked = lists.where("_block > 0").withColumn("_other", F.explode(F.sequence(F.lit(0), F.least("_block", "_own") - 1)))
    other = first.select("node", F.col("_block").alias("_other"), F.col("members").alias("block"))
    return alone.unionByName(asked.join(other, ["node", "_other"]).select("node", "members", "block"))


def _leaf_links(
    leaves: DataFrame, sets: DataFrame, labels: DataFrame, docs: DataFrame, doc_id: str, text: str, percent: int
) -> DataFrame:
    """The links between sets of different components in nodes.

    The sets outside a node's largest component are compared with each other and with that component, whose own sets are
    not: first by sketches, to know which sets there are to be read, then these in full.
    """
    spark = sets.sparkSession
    dealt = written(spark, mixed(leaves, labels), "leaf-rows")
    within = dealt.groupBy(*KEY).agg(F.collect_list("node").alias("nodes"))
    members = written(spark, sets.select(*KEY, "n", "sketch").join(within, KEY).join(labels, KEY), "leaf-members")
    rows = dealt.select("node", *KEY, "_sets", "_others", "_main").join(members, KEY)
    own, rest = (F.ceil(c / LEAF) for c in (F.col("_others"), F.col("_sets") - F.col("_others")))
    block = F.when(F.col("_main"), own + F.pmod(F.xxhash64(*KEY), rest)).otherwise(F.pmod(F.xxhash64(*KEY), own))
    found = written(spark, sets_met(_in_blocks(rows, own, block, "leaves"), percent).distinct(), "sets-met")
    whole = _whole_sets(found.select(*KEY).distinct(), sets, docs, doc_id, text)
    about = found.groupBy("node").agg(F.ceil(F.sum("n") / SHINGLES_AT_ONCE).alias("_blocks"))
    rows = found.drop("n").join(about, "node").join(members.join(whole, KEY), KEY)
    block = F.pmod(F.xxhash64(*KEY), F.col("_blocks"))
    return in_one_leaf(_in_blocks(rows, F.col("_blocks"), block, "whole-leaves"), percent).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, trees: int = TREES
) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` (long), ``text_key``, ``n_shingles``, ``component_id`` and ``kept``.

    A row's set is that of its distinct ``SHINGLE_WORDS``-word shingles, with A-Z lower-cased and words between ASCII
    white space; fewer words are one shingle; a row without words, or with a null text, has none and is linked with
    nothing. Rows are linked from ``percent`` percent of common shingles, and ``component_id`` is the smallest id that
    can be reached. ``kept`` is true where that is the row's own id. Rows that repeat an id are told apart by their text
    (``text_key``). A null id is never the smallest; a component of only null ids has none and keeps its rows. Other
    columns are not looked at, and an empty table gives no rows. ``group_1`` and ``group_2`` name the component by its
    smallest set, also where it has only null ids; a row without words has none.
    """
    spark = docs.sparkSession
    rows = written(spark, sketches(docs, doc_id, text), "sketches")
    sets = rows.where("n > 0").groupBy(*KEY).agg(
        F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    sets = written(spark, sets, "sets")
    # What comparing large nodes in blocks may cost is in proportion to the table.
    enough = MET * LEAF * sets.count()
    # After so many levels a forest alone misses no more than it may.
    sure = next((n - 1 for n in range(1, LEVELS + 2) if missed(n, percent, trees) > MISSED), LEVELS + 1)
    members, known, left, forest = sets, None, 1.0, 0
    while True:
        # Each level meets the labels, so they are worked out when they change.
        nodes, labels = first_nodes(members, trees), written(spark, _labels(sets, known), "labels")
        leaves, deep, narrow = [], members if sure == 0 else None, None
        for level in range(LEVELS + 1):
            open_ = shared_nodes(nodes) if known is None else mixed(nodes, labels)
            open_ = written(spark, open_, "nodes")
            last = level == LEVELS or _met_in_blocks(open_) <= enough
            # What the first forest's stars have joined stays joined.
            if level <= FIRSTS_LEVEL and forest == 0 and (level == 0 or not last):
                asked = open_ if level == 0 else open_.where(F.col("_sets") > SMALL)
                links = confirmed(near_the_first(asked, sets, percent), sets, docs, doc_id, text, percent)
                links = written(spark, _as_links(links), "links")
                if not links.isEmpty():
                    links = links if known is None else known.unionByName(links)
                    known = written(spark, components(links), "components")
                    labels = written(spark, _labels(sets, known), "labels")
                    open_ = written(spark, mixed(open_.select("node", *KEY, "n"), labels), "nodes")
                    last = last or _met_in_blocks(open_) <= enough
                release(spark)
            leaves.append(open_.where((F.col("_others") <= LEAF) | F.lit(last)).select("node", *KEY))
            if last:
                break
            large = open_.where(F.col("_others") > LEAF)
            if level + 1 == sure:
                deep = large
            # Sets that are in no large node have no part in deeper levels.
            narrow = narrowed(members, large) if level <= FIRSTS_LEVEL + 1 else narrow
            nodes = next_nodes(large.join(narrow, KEY))
        found = _leaf_links(reduce(DataFrame.unionByName, leaves), sets, labels, docs, doc_id, text, percent)
        links = written(spark, _as_links(found), "links")
        if known is None or not links.isEmpty():
            links = links if known is None else known.unionByName(links)
            known = written(spark, components(links), "components")
        release(spark)
        left, forest = left * missed(level + 1, percent, trees), forest + 1
        if deep is None or left <= MISSED:
            break
        wanted, texts = _with_texts(deep.select(*KEY).distinct(), sets, docs, doc_id)
        members = signatures(texts, text, forest).join(wanted.select(*KEY), KEY, "left_semi")
        members = members.groupBy(*KEY).agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
        members = written(spark, members, "signatures")
    reached = known.toDF(*KEY, "v1", "v2")
    grouped = sets.select(*KEY, "doc").join(reached, KEY, "left")
    top = [F.coalesce("v1", "s1").alias("v1"), F.coalesce("v2", "s2").alias("v2")]
    grouped = grouped.select(*KEY, "doc", *top)
    least = grouped.groupBy("v1", "v2").agg(F.min("doc").alias("component_id"))
    by_set = grouped.join(least, ["v1", "v2"]).select(*KEY, "component_id", F.col("v1").alias("group_1"), F.col("v2").alias("group_2"))
    with_words = rows.where("n > 0").select("doc", "text_key", "n", *KEY).join(by_set, KEY).drop(*KEY)
    none = [F.lit(None).cast("long").alias(c) for c in ("group_1", "group_2")]
    without = rows.where("n = 0").select("doc", "text_key", "n", F.col("doc").alias("component_id"), *none)
    return with_words.unionByName(without).select(
        F.col("doc").alias(doc_id),
        "text_key",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        "group_1",
        "group_2",
    )


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with their columns: all rows that hold the smallest id."""
    gone = found.where(~F.col("kept")).select(F.struct(F.col(doc_id).cast("long").alias("doc")).alias("_doc"), F.col("text_key").alias("_key"))
    gone = gone.distinct()
    gone = F.broadcast(gone) if gone.count() <= IDS_SENT else gone
    keyed = docs.withColumns({"_doc": F.struct(F.col(doc_id).cast("long").alias("doc")), "_key": text_key(F.col(text))})
    return keyed.join(gone, ["_doc", "_key"], "left_anti").select(*docs.columns)


def one_row_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with its columns.

    Of the rows that hold the smallest id, or of all if a component has only null ids, the one with the smallest
    ``text_key`` stays; of rows that repeat an id and a text, also of those without words, one. ``found`` is read several
    times and should be a written table.
    """
    doc, group = F.struct(F.col(doc_id).cast("long").alias("doc")).alias("_doc"), ["group_1", "group_2"]
    rows = found.select(doc, F.col("text_key").alias("_key"), "kept", *group)
    first = rows.where("kept and group_1 is not null").groupBy(*group).agg(F.min(F.struct("_doc", "_key")).alias("_first"))
    first = first.select("_first._doc", "_first._key")
    gone = rows.where("group_1 is not null").select("_doc", "_key").distinct().join(first, ["_doc", "_key"], "left_anti")
    repeated = rows.groupBy("_doc", "_key").count().where("count > 1").drop("count")
    repeated = repeated.join(gone, ["_doc", "_key"], "left_anti")
    gone, repeated = (F.broadcast(x) if x.count() <= IDS_SENT else x for x in (gone, repeated))
    keyed = docs.withColumns({"_doc": F.struct(F.col(doc_id).cast("long").alias("doc")), "_key": text_key(F.col(text))})
    kept = keyed.join(gone, ["_doc", "_key"], "left_anti")
    once = kept.join(repeated, ["_doc", "_key"], "left_anti").select(*docs.columns)
    # Rows that differ in other columns only: the order makes it one of them.
    order = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c != text), F.col("_key")))
    again = kept.join(repeated, ["_doc", "_key"], "left_semi").groupBy("_doc", "_key")
    again = again.agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
    return once.unionByName(again)
