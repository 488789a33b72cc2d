"""Frame operators against plain Python on small random traces."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.predicates import testbed_only as in_testbed
from tracelake.operators import frames, late, ordinals, skew

KEY = ("trace_id",)


def random_frames(seed=1, n=300, traces=3):
    rng = random.Random(seed)
    rows = []
    for pos in rng.sample(range(4 * n), n):
        # One trace holds most of the frames.
        trace = 0 if rng.random() < 0.7 else rng.randrange(traces)
        rows.append((trace, pos, rng.choice(["/testbed/a.py", "/testbed/b.py", "/x/c.py"]), rng.choice("fgh"), rng.randrange(4)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(random_frames(), "trace_id int, pos long, file string, func string, line int")


def by_trace(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(tuple(row))
    return out


def test_dedup_keeps_the_first_and_is_idempotent(table):
    want = []
    for rows in by_trace(random_frames()).values():
        seen = set()
        for r in rows:
            if (r[2], r[3]) not in seen:
                seen.add((r[2], r[3]))
                want.append(r)
    once = frames.dedup_frames(table, keys=KEY)
    assert sorted(map(tuple, once.collect())) == sorted(want)
    assert sorted(map(tuple, frames.dedup_frames(once, keys=KEY).collect())) == sorted(want)
    with pytest.raises(ValueError):
        frames.dedup_frames(table, ())


@pytest.mark.parametrize("n", [0, 1, 5, 10_000])
def test_cap_keeps_the_first(table, n):
    want = [r for rows in by_trace(random_frames()).values() for r in rows[:n]]
    assert sorted(map(tuple, frames.cap_frames(table, n, KEY).collect())) == sorted(want)
    ranged = ordinals.leading_rows(table, KEY, "pos", n, rows_per_task=20)
    assert sorted(map(tuple, ranged.collect())) == sorted(want)


def test_cap_after_dedup_does_not_count_duplicates(spark):
    rows = [(1, i, f, "m", 1) for i, f in enumerate("aabc")]
    df = spark.createDataFrame(rows, "trace_id int, pos long, file string, func string, line int")
    steps = [lambda d: frames.dedup_frames(d, ("file",), KEY), lambda d: frames.cap_frames(d, 2, KEY)]
    assert [r.file for r in frames.frame_pipeline(df, steps).orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        frames.cap_frames(df, -1)


@pytest.mark.parametrize("rows_per_task", [1, 40, 1 << 20])
def test_sequence_number_over_slices(table, rows_per_task):
    want = sorted((t, r[1], i) for t, rows in by_trace(random_frames()).items() for i, r in enumerate(rows))
    got = ordinals.sequence_number(table, KEY, "pos", "n", rows_per_task=rows_per_task).select("trace_id", "pos", "n").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("rows_per_task", [1, 40, 1 << 20])
def test_previous_value_over_slices(table, spark, rows_per_task):
    rows = [(t, p, None if line == 0 else line) for t, p, _, _, line in random_frames()]
    df = spark.createDataFrame(rows, "trace_id int, pos long, v int")
    want = []
    for trace in by_trace(rows).values():
        want += [(r[0], r[1], before[2] if before else None) for before, r in zip([None, *trace], trace)]
    got = ordinals.previous_value(df, KEY, "pos", "v", "old", rows_per_task=rows_per_task).select("trace_id", "pos", "old").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows_per_task", [1, 40, 1 << 20])
def test_groups_with_null_keys_and_global_positions(spark, rows_per_task):
    """Null keys are a group; positions far apart, null or equal are no harder than close ones."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), n * 10**9 if n % 7 else None, n, rng.choice([None, 1, 5])) for n in range(200)]
    df = spark.createDataFrame(rows, "trace_id int, pos long, n long, amount long").repartition(5)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    want, firsts, before = [], [], []
    for group in groups.values():
        done = 0
        for at, r in enumerate(group):
            want.append((r[0], r[2], at, len(group), done))
            before.append((r[0], r[2], group[at - 1][3] if at else None))
            done += r[3] or 0
        firsts += [(r[0], r[2]) for r in group[:9]]
    order = ["pos", "n"]
    numbered = ordinals.sequence_number(
        df, KEY, order, "at", total="size", sums={"done": F.col("amount")}, rows_per_task=rows_per_task
    )
    got = [(r.trace_id, r.n, r.at, r.size, r.done) for r in numbered.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    first = ordinals.leading_rows(df, KEY, order, 9, rows_per_task=rows_per_task).collect()
    assert sorted([(r.trace_id, r.n) for r in first], key=repr) == sorted(firsts, key=repr)
    lagged = ordinals.previous_value(df, KEY, order, "amount", "old", rows_per_task=rows_per_task).collect()
    assert sorted([(r.trace_id, r.n, r.old) for r in lagged], key=repr) == sorted(before, key=repr)
    assert ordinals.sequence_number(df.limit(0), KEY, "pos", "at").count() == 0


def test_hot_groups_are_spread(spark):
    df = spark.range(4000).selectExpr("if(id < 3000, 0, id) as trace_id", "id * 1000003 as pos")
    bounds = ordinals._bounds(df, KEY, "pos", 100)
    sliced = ordinals._sliced(df, bounds, KEY, "pos", "inner")
    sizes = [r["count"] for r in sliced.groupBy("trace_id", "_slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 30
    # Without a hot group, the plan that runs has one exchange of the rows and no join.
    plain = ordinals.sequence_number(df, KEY, "pos", "at")
    plain.collect()
    final = plain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in final


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_the_plain_join(spark, table, how):
    right = spark.createDataFrame([("/testbed/a.py", 1), ("/testbed/a.py", 2), ("/x/c.py", 3)], "file string, v int")
    hot = skew.hot_keys(skew.key_counts(table, ["file"]), ["file"], rows_per_task=20)
    assert all(r._salts > 1 for r in hot.collect())
    got = skew.salted_join(table, right, ["file"], ["pos"], how, rows_per_task=20)
    want = table.join(right, "file", how)
    key = lambda r: repr(tuple(r))
    assert sorted(got.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_hot_keys_are_bounded_by_their_share(spark, monkeypatch):
    counts = spark.createDataFrame([(f"k{n}", 10) for n in range(30)] + [("big", 900), (None, 5000)], "file string, _rows long")
    assert skew.hot_keys(counts, ["file"], rows_per_task=5).count() == 31
    monkeypatch.setattr(skew, "HOT_SHARE", 0.01)
    # A hundredth of 6,200 rows: only one key is above it.
    assert [(r.file, r._salts) for r in skew.hot_keys(counts, ["file"], rows_per_task=5).collect()] == [("big", 15)]


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(2000).selectExpr("id", "cast(null as string) as file", "'x' as other")
    right = spark.createDataFrame([(None, 1), ("a", 2)], "file string, v int")
    got = skew.salted_join(left, right, ["file"], ["id"], "left")
    assert got.count() == 2000 and got.where("v is not null").count() == 0
    assert skew.salted_join(left, right, ["file"], ["id"], "inner").count() == 0


def test_result_does_not_depend_on_partitions(table):
    def kept(df):
        return sorted(map(tuple, frames.exec_path_pipeline(df.select("trace_id", "pos", "file", "func", "line"), KEY, 4).collect()))

    assert kept(table.repartition(7, "line")) == kept(table.coalesce(1))


def test_pipeline_output_is_an_ordered_subset(table):
    out = frames.exec_path_pipeline(table, KEY).collect()
    places = {(r[0], r[1]): r for r in random_frames()}
    assert all(tuple(r[c] for c in ("trace_id", "pos", "file", "func", "line")) == places[r.trace_id, r.pos] for r in out)
    assert all(r.file.startswith("/testbed/") for r in out)


def test_a_user_step_can_be_a_function_or_a_column(table):
    steps = [in_testbed(), lambda d: d.where(F.col("line") > 1)]
    got = frames.frame_pipeline(table, steps).collect()
    assert got and all(r.line > 1 and r.file.startswith("/testbed/") for r in got)


def test_explode_and_nest_round_trip(spark):
    frame = "struct<file:string,line:int,func:string,locals:map<string,string>,meta:map<string,string>>"
    rows = [(1, [(f"f{i}", i, "g", {"k": str(i)}, {"m": "1"} if i == 0 else {}) for i in range(5)], [("p", "h", 7)], None)]
    traces = spark.createDataFrame(
        rows, f"trace_id int, frames array<{frame}>, exec_path array<struct<file:string,func:string,line:int>>, step_frames array<{frame}>"
    )
    exploded = frames.explode_frames(traces, KEY)
    got = sorted((r.kind, r.pos, r.file, r.line, r.func) for r in exploded.collect())
    assert got == [("exec_path", 0, "p", 7, "h")] + [("frames", i, f"f{i}", i, "g") for i in range(5)]
    # Positions with gaps, as event numbers have, do not split a trace.
    spread = exploded.withColumn("pos", F.col("pos") * 100_000 + 7)
    nested = frames.nest_frames(spread.where("kind = 'frames'"), KEY).orderBy("ordinal").collect()
    assert [(r.ordinal, r.frame.file) for r in nested] == [(i, f"f{i}") for i in range(5)]
    assert nested[0].frame.meta == {"m": "1"} and nested[1].frame.meta is None


def test_assemble_traces_ignores_other_kinds(spark):
    events = spark.createDataFrame(
        [(1, i, k, "a.py", "f", i) for i, k in enumerate(["call", "line", "return", "exception", "call"])],
        "trace_id int, seq long, kind string, file string, func string, line int",
    )
    got = sorted((r.kind, r.pos) for r in frames.assemble_traces(events, KEY).collect())
    assert got == [("exec_path", 0), ("exec_path", 4), ("frames", 2), ("step_frames", 1)]


def test_error_frame_keeps_nulls_of_the_last_frame(spark):
    df = spark.createDataFrame([(1, 0, "a", 3), (1, 1, None, 4)], "trace_id int, pos long, file string, line int")
    assert [tuple(r) for r in frames.error_frame(df, KEY).select("pos", "file", "line").collect()] == [(1, None, 4)]


def test_variable_changes_see_a_variable_come_and_go(spark):
    values = [{"k": "1"}, {"k": "1"}, {}, {"k": "2"}, {"k": "2"}]
    rows = [(1, i, "f", "a.py", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "trace_id int, pos long, func string, file string, line int, locals map<string,string>")
    got = frames.variable_changes(df, "k", KEY).orderBy("pos").collect()
    assert [(r.pos, r.old_value, r.new_value) for r in got] == [(0, None, "1"), (2, "1", None), (3, None, "2")]


def test_context_files_and_focus(spark):
    rows = [("frames", 0, "/t/lib.py", 5), ("frames", 1, "/t/util.py", 6), ("exec_path", 0, "/t/tests/x.py", 9), ("exec_path", 1, "/t/lib.py", 2)]
    df = spark.createDataFrame([(1, *r) for r in rows], "trace_id int, kind string, pos long, file string, line int")
    used = frames.files_by_first_use(frames.trace_context_frames(df, KEY), KEY, "ord")
    chosen = frames.context_files(used, KEY, 2)
    assert [r.file for r in chosen.orderBy("rank").collect()] == ["/t/tests/x.py", "/t/lib.py"]
    read = frames.files_to_read(chosen, used, KEY).orderBy("read_order").collect()
    assert [r.file for r in read] == ["/t/tests/x.py", "/t/lib.py", "/t/util.py"]
    assert [tuple(r) for r in frames.focus_test(used, chosen, KEY).collect()] == [(1, "/t/tests/x.py", 9)]
    without = used.where("file <> '/t/tests/x.py'")
    assert frames.focus_test(without, frames.context_files(without, KEY), KEY).count() == 0


def test_stats_of_no_traces(spark):
    empty = spark.createDataFrame([], "exc_type string, n int, trace_pos int")
    assert tuple(frames.trace_stats(empty, F.col("n")).first()) == (0, 0, 0, None)
    assert frames.exception_histogram(empty).count() == 0


# Late fetch


@pytest.fixture
def stored(spark, tmp_path):
    """Frames with a wide column, ties and null keys, in several files; some of these are empty."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 2, 2]), n, rng.choice("abc"), rng.choice("fg"), rng.randrange(3), {"v": "x" * n}) for n in range(150)]
    df = spark.createDataFrame(rows, "trace_id int, pos long, file string, func string, line int, locals map<string,string>")
    df.repartition(6, "pos").write.parquet(f"{tmp_path}/frames")
    df.limit(0).write.mode("append").parquet(f"{tmp_path}/frames")
    return spark.read.parquet(f"{tmp_path}/frames")


def same_rows(a, b):
    return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_addresses_are_those_of_the_rows(stored):
    table = late.file_rows(stored)
    rows = table.rows().collect()
    assert len({r.row_address for r in rows}) == 150 and len(table.paths) >= 6
    some = [r for r in rows if r.pos % 7 == 0]
    for first, last in ((0, None), (1, 3), (2, 2)):
        part = {r.pos: r.row_address for r in table.rows(first, last).collect()}
        assert all(r.row_address == part[r.pos] for r in rows if r.pos in part)
        assert len(part) == 150 or len(part) < 150 and last is not None
    chosen = stored.sparkSession.createDataFrame([(r.row_address,) for r in some], "row_address long")
    for most in (1, 10, 1000):
        assert same_rows(late.fetch_rows(table, chosen, round_rows=most), stored.where("pos % 7 = 0"))
    assert late.fetch_rows(table, chosen.limit(0)).count() == 0


def test_late_operators_equal_the_others(stored):
    table = late.file_rows(stored)
    assert same_rows(frames.late_dedup(table, ("file", "func"), KEY), frames.dedup_frames(stored, ("file", "func"), KEY))
    assert same_rows(frames.late_error_frame(table, KEY), frames.error_frame(stored, KEY))
    assert same_rows(frames.error_location(table, KEY), frames.error_location(stored, KEY))
    assert same_rows(frames.select_trace(table, KEY, "pos"), frames.select_trace(stored, KEY, "pos"))
    testbed = late.file_rows(stored, lambda rows: rows.withColumn("file", F.concat(F.lit("/testbed/"), "file")))
    want = frames.step_frames_pipeline(stored.withColumn("file", F.concat(F.lit("/testbed/"), "file")), KEY, 7)
    assert same_rows(frames.late_step_frames(testbed, KEY, 7), want)


def test_late_choices_stay_hash_aggregates(stored):
    table = late.file_rows(stored)
    for chosen in (late.first_of(table.rows(), ["trace_id", "file", "func"], "pos"), late.last_of(table.rows(), KEY, "pos")):
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "locals" not in plan.split("ReadSchema")[1].split("\n")[0]
