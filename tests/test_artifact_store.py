"""Stretches of stored texts are those of the texts."""

import random

import pytest

from tracelake.operators import ordinals
from tracelake.sources import artifact_store


@pytest.mark.parametrize("page", [4, 1 << 16])
@pytest.mark.parametrize("rows_per_task", [2, 1 << 20])
def test_stretches(spark, tmp_path, monkeypatch, page, rows_per_task):
    monkeypatch.setattr(artifact_store, "PAGE_BYTES", page)
    plain = ordinals.sequence_number
    monkeypatch.setattr(
        artifact_store, "sequence_number", lambda *a, **k: plain(*a, **({"rows_per_task": rows_per_task} | k))
    )
    rng = random.Random(page + rows_per_task)
    rows, texts = [], {}
    for key in ["a", "b", "c", None]:
        for ordinal in sorted(rng.sample(range(100), rng.randint(1, 14))):
            part = rng.choice([None, "", "x", "é\n", "word " * 5, "\U0001f600" * 3])
            rows.append((key, ordinal, part))
            texts[key] = texts.get(key, b"") + (part or "").encode()
    df = spark.createDataFrame(rows, "session string, ordinal long, text string").repartition(3)
    path = str(tmp_path)
    artifact_store.write_parts(df, path, ["session"])
    sizes = {r.session: r.total_bytes for r in artifact_store.text_sizes(spark, path, ["session"]).collect()}
    assert sizes == {k: len(t) for k, t in texts.items()}
    asked = [(n, rng.choice([*texts, "gone"]), rng.randint(-3, 90), rng.choice([0, 1, 7, 40, 500])) for n in range(80)]
    requests = spark.createDataFrame(asked, "request_id int, session string, first_byte int, n_bytes int")
    got = {r.request_id: bytes(r.bytes) for r in artifact_store.read_stretches(spark, path, requests, ["session"]).collect()}
    want = {n: texts.get(k, b"")[max(a, 0) : max(a + size, 0)] for n, k, a, size in asked}
    assert got == {n: t for n, t in want.items() if t}
    # The whole text is the stretch of all of its bytes.
    whole = spark.createDataFrame([(k, k, 0, 10**6) for k in texts], "request_id string, session string, first_byte int, n_bytes int")
    found = {r.request_id: bytes(r.bytes) for r in artifact_store.read_stretches(spark, path, whole, ["session"]).collect()}
    assert found == {k: t for k, t in texts.items() if t}


def test_an_empty_store(spark, tmp_path):
    empty = spark.createDataFrame([], "session string, ordinal long, text string")
    artifact_store.write_parts(empty, str(tmp_path), ["session"])
    requests = spark.createDataFrame([(1, "a", 0, 5)], "request_id int, session string, first_byte int, n_bytes int")
    assert artifact_store.read_stretches(spark, str(tmp_path), requests, ["session"]).count() == 0
