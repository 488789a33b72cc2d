"""Byte-level BPE, prefix counts and token files against the tokenizer libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import byte_bpe, prefix_counts, token_files
from tracelake.llm.queries import RANKS, TOKENIZER
from tracelake.llm.scanning import PATTERN

PARTS = ["a", "b", "the", " ", "  ", "\n", " \n", "'re", "'ll", "'", "r", "e", "1", "23", "é", "ß", "漢字", "!", "..."]
PARTS += ["\t", "\x1c", "՘", "\x00", " ", "aaaa", "ation", " s", "😀", "<|endoftext|>", "<|end", " word"]
LONG = ["a" * 3000, "漢字かな" * 800, " " * 2000 + "x", "\n" * 999 + " y", "ab cd " * 4000]


def random_texts(n: int, parts: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, parts))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pattern():
    return byte_bpe.tiktoken_pattern()


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i4").tolist()


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("leaf_chars", [5, 8192])
def test_encoding_is_the_library_s(library, pattern, leaf_chars):
    encoder = byte_bpe.RankEncoder(RANKS, pattern, leaf_chars)
    texts = random_texts(600, 40) + LONG
    for text, found in zip(texts, encoder.encode_many(texts)):
        assert ids_of(found) == library.encode_ordinary(text)
    tokens = byte_bpe.vocabulary(RANKS)
    lists = pa.array([library.encode_ordinary(text) for text in texts] + [None], pa.list_(pa.int32()))
    assert byte_bpe.decoded(tokens, lists) == [text.encode() for text in texts] + [b""]
    assert byte_bpe.decoded(tokens, lists.slice(3, 4)) == [text.encode() for text in texts[3:7]]
    for wrong in (-1, 50_256):
        with pytest.raises((ValueError, IndexError)):
            byte_bpe.decoded(tokens, pa.array([[wrong]], pa.list_(pa.int32())))


def test_long_lists_are_decoded_up_the_tree(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DECODED_AT_ONCE", 3)
    texts = ["The cat sat on the mat, é 中文. " * n for n in range(5)]
    lists = pa.array([library.encode_ordinary(text) for text in texts], pa.list_(pa.int32()))
    assert byte_bpe.decoded(byte_bpe.vocabulary(RANKS), lists) == [text.encode() for text in texts]


def test_halves_join_to_the_encoding_of_the_whole(pattern):
    merger = byte_bpe.RankEncoder(RANKS, pattern).merger
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choice(b"abcehinorst ") for _ in range(rng.randint(1, 300)))
        cut = rng.randint(0, len(data))
        assert merger.join(merger.merge(data[:cut]), merger.merge(data[cut:])) == merger.merge(data)


def test_encode_keeps_columns_and_takes_null_as_empty(spark, library):
    rows = [(1, "The cat.", 5), (2, None, None), (2, "", 6), (None, "The cat.", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    found = byte_bpe.encode(docs, RANKS)
    assert found.columns == ["doc_id", "text", "token_ids"]
    want = library.encode_ordinary("The cat.")
    assert sorted((r.token_ids for r in found.collect()), key=len) == [[], [], want, want]
    back = byte_bpe.decode(found, RANKS, out="text").collect()
    assert sorted(bytes(r.text) for r in back) == [b"", b"", b"The cat.", b"The cat."]
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_prefix_counts_are_the_library_s():
    library = Tokenizer.from_file(TOKENIZER)
    counter = prefix_counts.PrefixCounter(TOKENIZER, prefix_counts.tokenizers_pattern())

    def tokens(text: str) -> int:
        return len(library.encode(text, add_special_tokens=False).ids)

    rng = random.Random(9)
    for text in random_texts(400, 20):
        want = [tokens(text[: n + 1]) for n in range(len(text))]
        assert counter.all_prefixes(text).tolist() == want
        limit = rng.randint(0, 15)
        fits = max((n + 1 for n, c in enumerate(want) if c <= limit), default=0)
        assert counter.count_many([text], limit) == [((want or [0])[-1], fits)]
    for text in LONG:
        assert counter.count_many([text], 512)[0][0] == tokens(text)


def test_counting_rows(spark):
    rows = [(1, "The cat sat.", "x"), (2, None, "x"), (2, "", None), (3, "a" * 400, "x"), (3, "a" * 400, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = prefix_counts.count_tokens(docs, TOKENIZER, 3, prefixes=True)
    found = {(r.doc_id, r.text): r for r in counted.collect()}
    assert found[1, "The cat sat."].n_tokens == 4 and found[1, "The cat sat."].fitting_chars == 11
    assert found[2, None].n_tokens == found[2, ""].n_tokens == 0 and found[2, None].prefix_counts == []
    budget = {(r.doc_id, r.text): r.budget_chars for r in prefix_counts.within_budget(counted, 3).collect()}
    assert all(budget[k] == r.fitting_chars for k, r in found.items())
    assert prefix_counts.count_tokens(docs.limit(0), TOKENIZER, 3).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        prefix_counts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"), PATTERN)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    order = token_files.Permutation(n, 7)
    numbers = np.arange(n)
    slots = order.slots(numbers)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert order.numbers(slots).tolist() == numbers.tolist()
    if n == 1000:
        assert token_files.Permutation(n, 8).slots(numbers).tolist() != slots.tolist()
        # No run of the old order is left.
        assert (np.diff(slots) == 1).mean() < 0.02


def test_shards(spark, library, tmp_path):
    texts = ["The cat sat on the mat. " * n for n in range(12)] + [None, "The end.", "The end."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folder = str(tmp_path / "shards")
    total = token_files.write_shards(docs, RANKS, folder, 3, sequence_tokens=16, shard_slots=4, pad=9)
    ids = {n: library.encode_ordinary(t or "") for n, t in enumerate(texts)}
    assert total == sum(-(-len(i) // 16) for i in ids.values())
    records = token_files.read_from(spark, folder).withColumn("file", F.input_file_name()).collect()
    assert sorted(r.slot for r in records) == list(range(total))
    by_doc: dict[int, dict[int, list[int]]] = {}
    for r in records:
        assert len(r.record) == 32 and r.shard == r.slot // 4
        found = np.frombuffer(bytes(r.record), "<u2").tolist()
        assert found[r.n_tokens :] == [9] * (16 - r.n_tokens)
        by_doc.setdefault(r.doc, {})[r.sequence] = found[: r.n_tokens]
    assert {d: [x for n in sorted(s) for x in s[n]] for d, s in by_doc.items()} == {d: i for d, i in ids.items() if i}
    # One file per shard, each in slot order.
    assert len({r.file for r in records}) == len({r.shard for r in records}) == -(-total // 4)
    assert [r.slot for r in token_files.read_from(spark, folder, 5).collect() if r.slot < 5] == []
    # The records of a shard are one value at a fixed stride.
    for row in spark.read.parquet(folder).collect():
        own = sorted((r.slot, bytes(r.record)) for r in records if r.shard == row.shard)
        assert bytes(row.data) == b"".join(x for _, x in own) and row.stride == 32 and row.first_slot == own[0][0]
    for start in (0, 3, 4, total - 1, total):
        assert [r.slot for r in token_files.read_from(spark, folder, start).orderBy("slot").collect()] == [*range(start, total)]
    for shard in {r.shard for r in records}:
        slots = [r.slot for r in records if r.shard == shard]
        assert slots == sorted(slots)


def test_no_sequences(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert token_files.write_shards(docs, RANKS, str(tmp_path / "s"), 3) == 0
    assert token_files.read_from(spark, str(tmp_path / "s")).count() == 0
