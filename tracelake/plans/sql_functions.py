"""Filters and pipelines in SQL: functions of a session that do what the DataFrame operators do.

``register_filters`` makes the frame filters scalar SQL functions, which the optimizer inlines like any expression.
``register_pipelines`` makes the pipelines over a frames table SQL table functions: their bounds are arguments, and what
they select can be joined, filtered and aggregated like a table:

    SELECT trace_id, count(*) FROM frames_exec_path(500) GROUP BY trace_id

All of them are temporary: they last as long as the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import predicates
from tracelake.functions.locals import DEFAULT_CUTOFF, serialize_locals
from tracelake.operators import frames as frame_ops
from tracelake.schemas import TRACE_KEY

# Name: parameters and body. The texts are those of ``functions.predicates``.
FILTERS = {
    "not_frozen": ("file STRING", "NOT contains(file, '<') AND NOT contains(file, 'frozen')"),
    "not_site_packages": ("file STRING", f"NOT contains(file, '{predicates.SITE_PACKAGES}')"),
    "not_stdlib": (
        "file STRING, folders ARRAY<STRING> DEFAULT array()",
        f"endswith(file, '.py') AND NOT contains(file, '{predicates.STDLIB_MARKER}') AND NOT endswith(file, '{predicates.CONFTEST}') "
        "AND NOT exists(folders, f -> f <> '' AND startswith(file, f))",
    ),
    "testbed_only": (
        f"file STRING, marker STRING DEFAULT '{predicates.TESTBED}'",
        f"startswith(file, marker) AND NOT contains(file, '{predicates.SITE_PACKAGES}')",
    ),
    "not_conftest": ("file STRING", f"NOT endswith(file, '{predicates.CONFTEST}')"),
    "in_function": ("func STRING, name STRING", "func = name"),
    "not_in_repos": (
        "instance_id STRING, repos ARRAY<STRING>",
        "NOT exists(repos, r -> startswith(instance_id, replace(r, '/', '__')))",
    ),
    "failing_tests_only": ("phase STRING, outcome STRING", "phase = 'call' AND outcome <> 'passed'"),
    "captured_unittest": (
        "event STRING, traceback STRING",
        "event IN ('error', 'failure', 'subtest') AND traceback IS NOT NULL",
    ),
}


def register_filters(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the filters as SQL functions; their names."""
    for name, (parameters, body) in FILTERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS BOOLEAN RETURN {body}")
    return [prefix + name for name in FILTERS]


def register_pipelines(
    spark: SparkSession, frames: DataFrame, name: str = "frames", keys: Sequence[str] = TRACE_KEY
) -> list[str]:
    """Create the pipelines over a frames table as SQL table functions; their names.

    ``<name>_exec_path(max_frames)``, ``<name>_step_frames(max_frames, cutoff)`` and ``<name>_traceback(cutoff)``. Locals
    are cut to ``cutoff`` characters, at most to the default one. The table itself is the view ``<name>``.
    """
    frames.createOrReplaceTempView(name)
    key_list = ", ".join(keys)
    plain = ["pos", "file", "func", "line"]
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def columns(names: Sequence[str]) -> str:
        return ", ".join(f"{c} {types[c]}" for c in [*keys, *names])

    def capped(view: str, shown: str) -> str:
        number = f"row_number() OVER (PARTITION BY {key_list} ORDER BY pos)"
        return f"SELECT {shown} FROM (SELECT *, {number} AS _n FROM {view}) WHERE _n <= max_frames"

    cut = "transform_values(locals, (k, v) -> left(v, cutoff)) AS locals"
    selected = ", ".join([*keys, *plain])
    steps = [predicates.testbed_only(), predicates.not_conftest()]

    def of_kind(kind: str) -> DataFrame:
        return frames.where(F.col("kind") == kind)

    path = frame_ops.frame_pipeline(
        of_kind("exec_path").select(*keys, *plain), [*steps, lambda df: frame_ops.dedup_frames(df, ("file", "func"), keys)], None
    )
    path.createOrReplaceTempView(f"_{name}_exec_path")
    kept = frame_ops.frame_pipeline(
        of_kind("step_frames").select(*keys, *plain, "locals"),
        [*steps, lambda df: frame_ops.dedup_frames(df, ("file", "func", "line"), keys)],
        None,
    )
    kept.withColumn("locals", serialize_locals(F.col("locals"), DEFAULT_CUTOFF)).createOrReplaceTempView(f"_{name}_step_frames")
    traceback = frame_ops.traceback_pipeline(of_kind("frames").select(*keys, *plain, "locals"))
    traceback.createOrReplaceTempView(f"_{name}_traceback")
    limit = f"max_frames INT DEFAULT {frame_ops.EXEC_PATH_LIMIT}"
    step_limit = f"max_frames INT DEFAULT {frame_ops.STEP_FRAMES_LIMIT}, cutoff INT DEFAULT {DEFAULT_CUTOFF}"
    functions = {
        f"{name}_exec_path": (limit, columns(plain), capped(f"_{name}_exec_path", selected)),
        f"{name}_step_frames": (step_limit, columns([*plain, "locals"]), capped(f"_{name}_step_frames", f"{selected}, {cut}")),
        f"{name}_traceback": (
            f"cutoff INT DEFAULT {DEFAULT_CUTOFF}",
            columns([*plain, "locals"]),
            f"SELECT {selected}, {cut} FROM _{name}_traceback",
        ),
    }
    for function, (parameters, result, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({parameters}) RETURNS TABLE ({result}) RETURN {body}")
    return list(functions)
