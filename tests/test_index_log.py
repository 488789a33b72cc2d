"""A log of index records reads as what a run of single steps over a dictionary gives."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.sources import index_log

SCHEMA = "run_id string, instance_id string, status string, n int"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("run_id", "instance_id", "status", "n").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_by_one_equals_all_at_once(spark, tmp_path):
    rows = [("r", str(n), "passed", n) for n in range(6)] + [("s", "0", "failed", 7)]
    for n, row in enumerate(rows):
        assert index_log.append_records(frame(spark, [row]), f"{tmp_path}/single", f"b{n}")
    index_log.append_records(frame(spark, rows), f"{tmp_path}/whole", "all")
    assert rows_of(index_log.read_records(spark, f"{tmp_path}/single")) == sorted(rows)
    assert rows_of(index_log.read_records(spark, f"{tmp_path}/whole")) == sorted(rows)


def test_the_latest_record_counts(spark, tmp_path):
    """Random appends, retries, lost attempts and compactions against a dictionary."""
    rng = random.Random(3)
    path, known, done = str(tmp_path), {}, []
    for step in range(14):
        rows = [("r", str(k), rng.choice(["passed", "failed"]), step) for k in rng.sample(range(8), rng.randint(1, 4))]
        kind = rng.choice(["append", "append", "lost", "again", "compact"])
        if kind == "lost" or kind == "append":
            # What a lost attempt wrote is not read.
            frame(spark, [("r", "99", "lost", step)]).write.parquet(f"{path}/records/batch=b{step}")
        if kind in ("append", "lost"):
            if kind == "append":
                assert index_log.append_records(frame(spark, rows), path, f"b{step}")
                known |= {r[1]: r for r in rows}
                done.append(f"b{step}")
        elif kind == "again" and done:
            assert not index_log.append_records(frame(spark, rows), path, rng.choice(done))
        elif kind == "compact":
            index_log.compact(spark, path, f"c{step}")
        if known:
            assert rows_of(index_log.read_records(spark, path)) == sorted(known.values())
    assert len(done) > 3


def test_compaction_bounds_what_is_read(spark, tmp_path):
    path = str(tmp_path)
    for n in range(3):
        index_log.append_records(frame(spark, [("r", str(n % 2), "passed", n)]), path, f"b{n}")
    assert index_log.expired_batches(spark, path) == []
    assert index_log.compact(spark, path, "c") and not index_log.compact(spark, path, "c")
    assert index_log.expired_batches(spark, path) == [f"{path}/records/batch=b{n}" for n in range(3)]
    index_log.append_records(frame(spark, [("r", "0", "failed", 9)]), path, "b9")
    found = index_log.read_records(spark, path)
    assert rows_of(found) == [("r", "0", "failed", 9), ("r", "1", "passed", 1)]
    # Of the log; the addresses of what counts are a table of their own in the work folder.
    read = [f for f in found.inputFiles() if path in f]
    assert read and all("batch=c/" in f or "batch=b9/" in f for f in read)


def test_headers_are_finalised(spark, tmp_path):
    path = str(tmp_path)
    begun = spark.createDataFrame([("r", "m", None), ("s", "m", None)], "run_id string, model string, completed_at string")
    index_log.append_headers(begun, path, "begun")
    assert index_log.finalise_runs(spark, path, ["r"], "done", F.timestamp_seconds(F.lit(0)))
    assert not index_log.finalise_runs(spark, path, ["r"], "done")
    found = {r.run_id: (r.model, r.completed_at) for r in index_log.read_headers(spark, path).collect()}
    assert found["s"] == ("m", None) and found["r"][0] == "m" and found["r"][1].startswith("1970-01-01")


def test_two_writers_and_new_columns(spark, tmp_path):
    path = str(tmp_path)
    index_log.append_records(frame(spark, [("r", "0", "passed", 1)]), path, "a")
    # Another writer that had not seen the first commit.
    frame(spark, [("r", "0", "failed", 2)]).withColumn("note", F.lit("x")).write.parquet(f"{path}/records/batch=b")
    index_log._commit(spark, path, index_log.RECORDS, "b", 1, is_base=False)
    assert [tuple(r) for r in index_log.read_records(spark, path).collect()] == [("r", "0", "failed", 2, "x")]


def test_odd_logs(spark, tmp_path):
    with pytest.raises(ValueError):
        index_log.read_records(spark, str(tmp_path))
    for name in ("", "a/b", "..", "a=b"):
        with pytest.raises(ValueError):
            index_log.append_records(frame(spark, []), str(tmp_path), name)
    index_log.append_records(frame(spark, []), str(tmp_path), "empty")
    assert index_log.read_records(spark, str(tmp_path)).count() == 0
    index_log.append_records(frame(spark, [(None, "1", "a", 1), (None, "1", "b", 2), ("r", None, "c", 3)]), str(tmp_path), "nulls")
    assert len(index_log.read_records(spark, str(tmp_path)).collect()) == 2
