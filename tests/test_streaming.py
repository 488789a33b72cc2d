"""Streams give what the batch form gives, also when records arrive twice, late and with another result."""

import random

from pyspark.sql import functions as F

from tracelake.operators import metrics, outcomes
from tracelake.streaming import jobs

SCHEMA = "run_id string, instance_id string, variant string, output string, error string, success boolean, patch string"


def runs(start, stop):
    logs = ["Ran 2 tests in 0s\n\nOK", "FAILED (failures=1)", ""]
    return [("r", str(i), v, logs[(i + k) % 3], None, True, "p") for i in range(start, stop) for k, v in enumerate(("with_runtime", "without_runtime"))]


def test_repeated_records_count_once(spark, tmp_path):
    first, second = runs(0, 10), runs(5, 20)
    source, work = f"{tmp_path}/in", f"{tmp_path}/work"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        counts = jobs.running_counts(jobs.record_stream(stream).withColumn("recorded_at", F.current_timestamp()))
        jobs.write_counts(counts, f"{work}/out", f"{work}/state").awaitTermination()
        latest = jobs.latest_counts(spark.read.parquet(f"{work}/out"))
        return {r.variant: (r.total_instances, r.success_count) for r in jobs.metrics_of_counts(latest).collect()}

    def batch(rows):
        df = spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA)
        records = outcomes.normalize_records(outcomes.outcomes(df))
        return {r.variant: (r.total_instances, r.success_count) for r in metrics.variant_metrics(records).collect()}

    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == batch(first)
    # The query stopped; it goes on from its checkpoint when more files arrive.
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == batch(first + second)


def test_record_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(runs(0, 6), SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.record_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    jobs.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = jobs.record_stream(df).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


RECORDS = "run_id string, instance_id string, variant string, status string, failure_reason string, recorded_at timestamp"


def counted(df):
    return sorted((tuple(r) for r in df.select("run_id", "variant", "status", "failure_reason", "n").collect()), key=repr)


def test_counts_take_back_what_a_newer_record_replaces(spark, tmp_path):
    """Deliveries in any order, over several starts of the query, against the batch count of all of them."""
    from datetime import datetime

    rng = random.Random(8)
    found = [("passed", None), ("failed", "tests_failed"), ("failed", "no_diff"), ("error", "x"), (None, None)]
    rows = []
    for _ in range(120):
        status, reason = rng.choice(found)
        at = rng.choice([None, datetime(2024, 1, rng.randint(1, 28))])
        rows.append((rng.choice(["r", "s", None]), str(rng.randrange(9)), rng.choice(["with_runtime", "without_runtime"]), status, reason, at))
    rows += rng.sample(rows, 40)
    source, work = f"{tmp_path}/in", f"{tmp_path}/work"
    for start in range(0, len(rows), 40):
        spark.createDataFrame(rows[start : start + 40], RECORDS).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.write_changes(jobs.count_changes(stream), f"{work}/out", f"{work}/state").awaitTermination()
        arrived = spark.createDataFrame(rows[: start + 40], RECORDS)
        assert counted(jobs.sum_of_changes(spark.read.parquet(f"{work}/out"))) == counted(jobs.record_counts(arrived))
    latest = {}
    rank = {None: 0}
    from tracelake.schemas import STATUSES

    rank |= {s: n + 1 for n, s in enumerate(STATUSES)}
    for run, instance, variant, status, reason, at in rows:
        order = (at.timestamp() if at else 0, rank.get(status, 0), reason or "")
        key = (run, instance, variant)
        if key not in latest or order > latest[key][0]:
            latest[key] = (order, status, reason)
    want = {}
    for (run, _, variant), (_, status, reason) in latest.items():
        want[run, variant, status, reason] = want.get((run, variant, status, reason), 0) + 1
    got = {r[:4]: r[4] for r in (tuple(r) for r in jobs.record_counts(spark.createDataFrame(rows, RECORDS)).select("run_id", "variant", "status", "failure_reason", "n").collect())}
    assert got == want


def test_records_that_share_a_state_keep_their_own(spark, tmp_path):
    """Python is called once per bucket: with one bucket, one state has all records, of null and of odd names too."""
    from datetime import datetime

    names = ["a", "b", None, "", "null", 'a","b', "é"]
    rows = [(run, name, "v", "failed", name, datetime(2024, 1, day)) for run in ("r", None) for name in names for day in (1, 3)]
    rows += [(run, name, "v", "passed", None, datetime(2024, 1, 2)) for run in ("r", None) for name in names]
    later = [("r", "a", "v", "error", "x", datetime(2024, 1, 4)), ("r", "b", "v", "error", "x", datetime(2024, 1, 2))]
    source = f"{tmp_path}/in"
    for part in (rows, later):
        spark.createDataFrame(part, RECORDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(source)
        changes = jobs.count_changes(stream, buckets=1)
        jobs.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = jobs.sum_of_changes(spark.read.parquet(f"{tmp_path}/out"))
    assert counted(got) == counted(jobs.record_counts(spark.createDataFrame(rows + later, RECORDS)))
