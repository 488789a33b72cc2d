"""The SQL functions give what the DataFrame operators give."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import predicates
from tracelake.operators import frames
from tracelake.plans import sql_functions

KEY = ("trace_id",)
FILES = ["/testbed/a.py", "/testbed/conftest.py", "/testbed/site-packages/x.py", "<frozen x>", "/usr/lib/python3/json.py", "/opt/b.py", "a.so", None]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    kinds = ["frames", "exec_path", "step_frames"]
    rows = [(rng.choice([None, 1, 2]), n, rng.choice(kinds), rng.choice(FILES), rng.choice("fg"), rng.randrange(3), {"k": "é\"" * (n % 9)}) for n in range(400)]
    return spark.createDataFrame(rows, "trace_id int, pos long, kind string, file string, func string, line int, locals map<string,string>")


def same(a, b):
    return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_filters(spark, table):
    assert set(sql_functions.register_filters(spark, "tl_")) == {f"tl_{n}" for n in sql_functions.FILTERS}
    table.createOrReplaceTempView("some_frames")
    columns = {
        "tl_not_frozen(file)": predicates.not_frozen(),
        "tl_not_site_packages(file)": predicates.not_site_packages(),
        "tl_not_stdlib(file)": predicates.not_stdlib(),
        "tl_not_stdlib(file, array('/opt', ''))": predicates.not_stdlib(["/opt", ""]),
        "tl_testbed_only(file)": predicates.testbed_only(),
        "tl_testbed_only(file, '/opt')": predicates.testbed_only("/opt"),
        "tl_not_conftest(file)": predicates.not_conftest(),
        "tl_in_function(func, 'f')": predicates.in_function("f"),
        "tl_not_in_repos(file, array('/testbed/a', '<frozen'))": predicates.not_in_repos(["/testbed/a", "<frozen"], F.col("file")),
        "tl_failing_tests_only(func, file)": predicates.failing_tests_only(F.col("func"), F.col("file")),
        "tl_captured_unittest(func, file)": predicates.captured_unittest(F.col("func"), F.col("file")),
    }
    for call, column in columns.items():
        assert same(spark.sql(f"SELECT pos FROM some_frames WHERE {call}"), table.where(column).select("pos")), call
    plan = spark.sql("SELECT * FROM some_frames WHERE tl_not_conftest(file)")._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith(file" in plan.replace("endswith", "EndsWith").replace("EndsWith(file#", "EndsWith(file")


def test_pipelines(spark, table):
    names = sql_functions.register_pipelines(spark, table, "runs", KEY)
    assert names == ["runs_exec_path", "runs_step_frames", "runs_traceback"]
    kind = F.col("kind")
    path = frames.exec_path_pipeline(table.where(kind == "exec_path"), KEY)
    assert same(spark.sql("SELECT * FROM runs_exec_path()"), path)
    assert same(spark.sql("SELECT * FROM runs_exec_path(2)"), frames.exec_path_pipeline(table.where(kind == "exec_path"), KEY, 2))
    steps = frames.step_frames_pipeline(table.where(kind == "step_frames"), KEY, 3, 5).drop("kind")
    assert same(spark.sql("SELECT * FROM runs_step_frames(3, 5)"), steps)
    traceback = frames.traceback_pipeline(table.where(kind == "frames"), (), 4).drop("kind")
    assert same(spark.sql("SELECT * FROM runs_traceback(cutoff => 4)"), traceback)
    joined = spark.sql("SELECT p.trace_id, count(*) AS n FROM runs_exec_path(1) p JOIN runs t ON t.trace_id <=> p.trace_id GROUP BY 1")
    assert joined.count() == 3
