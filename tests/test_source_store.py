"""Sources by hash give what the files give, with each text written once."""

import random

import pytest

from tracelake.operators import source
from tracelake.sources import source_store


def some_files(rng):
    texts = ["", "one", "a\nb\nc", "x\r\ny\n", "é\n" * 30, None]
    return [(f"i{n}", f"/testbed/f{k}.py", rng.choice(texts)) for n in range(6) for k in range(4)]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("steps", [1, 3])
def test_store(spark, tmp_path, steps):
    rng = random.Random(steps)
    every, schema, path = some_files(rng), "instance_id string, path string, content string", str(tmp_path)
    for n in range(steps):
        source_store.add_sources(spark.createDataFrame(every[n::steps], schema), path)
    # The same again changes nothing.
    source_store.add_sources(spark.createDataFrame(every[:5], schema), path)
    known = [f for f in every if f[2] is not None]
    assert rows(source_store.read_files(spark, path).select("instance_id", "path", "content")) == rows(spark.createDataFrame(known, schema))
    stored = spark.read.parquet(f"{path}/contents")
    assert stored.count() == stored.select("hash").distinct().count() == len({f[2] for f in known})
    frames = [(rng.choice([f"i{n}" for n in range(7)] + [None]), n, f"/testbed/f{rng.randrange(5)}.py", rng.choice([None, -3, 0, 1, 2, 3, 29, 31, 10**9])) for n in range(200)]
    df = spark.createDataFrame(frames, "instance_id string, pos long, file string, line long")
    files = spark.createDataFrame(known, schema)
    want = source.with_source_context(df, files, 2)
    got = source_store.with_stored_context(df, path, 2)
    assert rows(got.select(*want.columns)) == rows(want)


def test_a_text_moves_once(spark, tmp_path):
    """Each distinct text is split once, whatever number of instances share it."""
    text = "\n".join(f"line {n}" for n in range(50))
    files = spark.createDataFrame([(f"i{n}", "/a.py", text) for n in range(40)], "instance_id string, path string, content string")
    source_store.add_sources(files, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/contents").count() == 1
    frames = spark.createDataFrame([(f"i{n % 40}", n, "/a.py", n % 50 + 1) for n in range(2000)], "instance_id string, pos long, file string, line int")
    shown = source_store.with_stored_context(frames, str(tmp_path), 1).collect()
    assert len(shown) == 2000 and all(f"{r.line} -> : line {r.line - 1}" in r.context for r in shown)
    assert source_store.with_stored_context(frames.limit(0), str(tmp_path)).count() == 0
