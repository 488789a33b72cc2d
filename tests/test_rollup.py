"""Counts that grow by batches equal a full count of what is recorded in the end."""

import random

import pytest

from tracelake.operators import metrics, rollup

SCHEMA = "run_id string, instance_id string, variant string, status string, failure_reason string"
STATUS = [("passed", None), ("passed", "odd"), ("failed", "x"), ("failed", ""), ("error", None), (None, "y")]


def test_batches_equal_a_recount(spark, tmp_path):
    rng = random.Random(4)
    path, known = str(tmp_path / "counts"), {}
    assert rollup.read_counts(spark, path).count() == 0
    for batch in range(4):
        rows = {}
        for _ in range(40):
            key = (rng.choice("rs"), str(rng.randrange(25)), rng.choice(["with_runtime", "without_runtime"]))
            rows[key] = (*key, *rng.choice(STATUS))
        replaced = [known[k] for k in rows if k in known]
        counts = rollup.count_batch(
            spark.createDataFrame(list(rows.values()), SCHEMA), spark.createDataFrame(replaced, SCHEMA) if replaced else None
        )
        for _ in range(rng.randint(1, 2)):
            rollup.add_counts(counts, path, f"b{batch}")
        known |= rows
        every = spark.createDataFrame(list(known.values()), SCHEMA)
        got = sorted(map(tuple, rollup.read_counts(spark, path).collect()), key=repr)
        assert got == sorted(map(tuple, rollup.count_batch(every).collect()), key=repr)
        rolled = rollup.rollup_metrics(rollup.read_counts(spark, path)).collect()
        want = {(r.run_id, r.variant): r for r in metrics.variant_metrics(every).collect()}
        fine = {(r.run_id, r.variant): r for r in rolled if r.level == 0}
        assert set(fine) == set(want)
        for key, r in fine.items():
            assert (r.total_instances, r.success_count, r.success_rate) == (
                want[key].total_instances, want[key].success_count, pytest.approx(want[key].success_rate),
            )
        (total,) = (r for r in rolled if r.level == 3)
        assert total.total_instances == len(known) and sum(r.total_instances for r in rolled if r.level == 1) == len(known)
    reasons = {(r.run_id, r.variant, r.failure_reason): r.n for r in rollup.reason_totals(rollup.read_counts(spark, path)).collect()}
    want = {(r.run_id, r.variant, r.failure_reason): r.n for r in metrics.failure_reason_counts(every).collect()}
    assert reasons == want
    rollup.compact_counts(spark, path, str(tmp_path / "compact"))
    base = rollup.read_counts(spark, str(tmp_path / "compact"))
    assert sorted(map(repr, base.collect())) == sorted(map(repr, rollup.read_counts(spark, path).collect()))
