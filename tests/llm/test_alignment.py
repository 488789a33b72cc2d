"""Token alignment against brute force over byte ranges."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracelake.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01"


@lru_cache(None)
def byte_of(character):
    """The byte behind a character of a byte-level vocabulary, by its definition."""
    code = ord(character)
    if code < 256:
        return code
    return [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)][code - 256]


def sides(text, tokenizer, pieces):
    """(id, start, end) of both sides, or nothing."""
    if not text:
        return [], []
    entries = tokenizer.encode(" " + text, add_special_tokens=False)
    a = [(n, bytes(map(byte_of, tokenizer.id_to_token(n)))) for n in entries.ids]
    b = []
    for n in pieces.encode(text):
        piece = pieces.id_to_piece(n)
        byte = re.fullmatch("<0x(..)>", piece)
        b.append((n, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if not b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for n, data in side:
            spans.append((n, at, at + len(data)))
            at += len(data)
        out.append(spans)
    return out


def by_hand(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    found, counts = [], Counter()
    for text in texts:
        a, b = sides(text, tokenizer, pieces)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        inside = [[[] for _ in cuts] for _ in range(2)]
        for side, into in zip((a, b), inside):
            for n, _, e in side:
                into[bisect_left(cuts, e)].append(str(n))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*inside)]
        overlaps, first = [], 0
        for x, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            at = first
            while at < len(b) and b[at][1] < e:
                overlaps.append((x, b[at][0]))
                at += 1
        counts.update(overlaps)
        found.append((len(a), len(b), len(groups), overlaps, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (
            n_a,
            n_b,
            n_groups,
            len(ov),
            sum(counts[p] == best[p[1]] for p in ov),
            sum(counts[p] for p in ov),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
            text,
        )
        for n_a, n_b, n_groups, ov, text in found
    ]


def numbers(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_groups_and_links_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        full = np.unique(rng.integers(1, 150, rng.integers(1, 90)))
        a, b = (np.append(full[rng.random(len(full)) < rng.random()], 200) for _ in range(2))
        last_a, last_b = alignment.close_groups(a, b)
        common = np.intersect1d(a, b)
        assert a[last_a].tolist() == b[last_b].tolist() == common.tolist()
        starts_a, starts_b = (np.concatenate([[0], x[:-1]]) for x in (a, b))
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]]
        link_a, link_b = alignment.links(a, b, last_b)
        assert list(zip(link_a.tolist(), link_b.tolist())) == want


@pytest.mark.parametrize("size", [1, 3, 4, 5, 64, 1000])
def test_long_stretches_are_jumped(size):
    a = np.arange(1, size + 1)
    assert alignment.close_groups(a, a)[1].tolist() == list(range(size))
    shifted = np.append(a + 3, size + 9)
    b = np.concatenate([[1, 2], a + 3, [size + 5, size + 9]])
    last_a, last_b = alignment.close_groups(shifted, b)
    assert last_a.tolist() == list(range(size + 1)) and last_b.tolist() == [*range(2, size + 2), size + 3]


TEXTS = [
    None,
    "",
    " ",
    "one two three",
    "one two three",
    "a  b\n\tc",
    "<|endoftext|> <s> </s> <0x41> <unk>",
    "▁ is a mark of its own",
    "café 中文 \U0001f600 \x00 é",
    "x" * 3000,
    "\n",
    "word " * 4000 + "end",
    "word " * 40,
    " a\n b\t  c \u3000 d\x1c e\u2028 f  ",
    "don't  'stop' 12 34.5 -- x\r\n y",
    "one two\u2581 three",
]


def test_align(spark, monkeypatch):
    # Many chunks, of which one text may be all.
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    rows = [(n, t, 7, True) for n, t in enumerate(TEXTS)] + [(3, TEXTS[3], 8, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_best int, chunk boolean").repartition(3)
    found = alignment.align(spark, docs, A, B, with_groups=True)
    assert found.columns == ["doc_id", "chunk", *alignment.RESULTS]
    got = sorted([(r.doc_id, *numbers(r), r.groups) for r in found.collect()], key=repr)
    assert got == sorted([(r[0], *x) for r, x in zip(rows, by_hand([r[1] for r in rows]))], key=repr)
    assert all(g[1:7] == (0,) * 6 for g in got if g[0] in (7, 15))
    assert alignment.align(spark, docs.limit(0), A, B).count() == 0
    only_texts = alignment.align(spark, docs.select("text").where("text is null"), A, B)
    assert [numbers(r) for r in only_texts.collect()] == [(0,) * 6 + ("",)] * 2


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = {doc: x[:-1] for (doc, _), x in zip(rows, by_hand([t for _, t in rows]))}
    got = {r.doc_id: numbers(r) for r in queries.op12_token_alignment(spark, SMALL).collect()}
    assert len(rows) == len(want) and got == want


def test_units_are_as_good_as_whole_texts(monkeypatch):
    pair = alignment.Pair(A, B)
    assert pair.splits
    rows = duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' LIMIT 200").fetchall()
    texts = TEXTS + [t for t, in rows]
    found = pair.chunk(texts)
    monkeypatch.setattr(alignment, "CHARS_KEPT", 0)
    assert [pair.chunk([t])["groups"] for t in TEXTS] == [[g] for g in found["groups"][: len(TEXTS)]]
    pair.splits = False
    whole = pair.chunk(texts)
    assert found["groups"] == whole["groups"]
    assert all(found[n].tolist() == whole[n].tolist() for n in alignment.NUMBERS)
    counts = [dict(zip(x["pairs"].tolist(), x["counts"].tolist())) for x in (found, whole)]
    assert counts[0] == counts[1]
