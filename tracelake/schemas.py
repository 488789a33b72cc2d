"""Table schemas, enum values and key columns of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Identity of one failing test, and of one variant run.
TRACE_KEY = ("run_id", "instance_id", "variant", "trace_pos")
RUN_KEY = ("run_id", "instance_id")

# Fixed values of the data model.
BASELINE = "baseline"
WITHOUT_RUNTIME = "without_runtime"
WITH_RUNTIME = "with_runtime"
VARIANTS = (WITHOUT_RUNTIME, WITH_RUNTIME)

STATUSES = ("passed", "failed", "unknown", "apply_failed", "not_run")
VERDICTS = ("fixed", "improved", "unchanged", "regressed", "not_run", "unknown")
FRAMEWORKS = ("pytest", "unittest", "django", "unknown")
FRAME_KINDS = ("frames", "exec_path", "step_frames")

TEXT_MAP = T.MapType(T.StringType(), T.StringType())

FRAME = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("func", T.StringType()),
        T.StructField("locals", TEXT_MAP),
        T.StructField("meta", TEXT_MAP),
    ]
)

OUTCOME = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("failure_count", T.LongType()),
        T.StructField("ran_tests", T.LongType()),
        T.StructField("summary_line", T.StringType()),
    ]
)

RUN_RESULT = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("trace_path", T.StringType()),
        T.StructField("num_failures", T.LongType()),
        T.StructField("runtime", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("traceback", T.StringType()),
        T.StructField("test_output_path", T.StringType()),
    ]
)

BASELINE_REPORT = T.StructType(
    [
        T.StructField("run_result", RUN_RESULT),
        T.StructField("trace_path", T.StringType()),
        T.StructField("test_output_path", T.StringType()),
        T.StructField("trace_count", T.IntegerType()),
        T.StructField("outcome", OUTCOME),
    ]
)

VARIANT_REPORT = T.StructType(
    [
        T.StructField("variant", T.StringType()),
        T.StructField("prompt_path", T.StringType()),
        T.StructField("response_path", T.StringType()),
        T.StructField("patch_path", T.StringType()),
        T.StructField("generated_patch", T.StringType()),
        T.StructField("run_skipped", T.BooleanType()),
        T.StructField("run_result", RUN_RESULT),
        T.StructField("outcome", OUTCOME),
        T.StructField("test_output_path", T.StringType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField(BASELINE, BASELINE_REPORT),
        T.StructField(WITHOUT_RUNTIME, VARIANT_REPORT),
        T.StructField(WITH_RUNTIME, VARIANT_REPORT),
        T.StructField("patches", TEXT_MAP),
        T.StructField("comparison", TEXT_MAP),
    ]
)

_RECORD_CORE = [
    T.StructField("status", T.StringType()),
    T.StructField("failure_count", T.LongType()),
    T.StructField("ran_tests", T.LongType()),
    T.StructField("summary_line", T.StringType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("raw_error_excerpt", T.StringType()),
]

BASELINE_RECORD = T.StructType(
    _RECORD_CORE
    + [
        T.StructField("trace_path", T.StringType()),
        T.StructField("test_output_path", T.StringType()),
    ]
)

VARIANT_RECORD = T.StructType(
    _RECORD_CORE
    + [
        T.StructField("prompt_path", T.StringType()),
        T.StructField("response_path", T.StringType()),
        T.StructField("patch_path", T.StringType()),
        T.StructField("test_output_path", T.StringType()),
    ]
)

INDEX_RECORD = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("recorded_at", T.StringType()),
        T.StructField("artifact_report_path", T.StringType()),
        T.StructField("baseline", BASELINE_RECORD),
        T.StructField("variants", T.MapType(T.StringType(), VARIANT_RECORD)),
    ]
)

INDEX_HEADER = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("predictions_path", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("completed_at", T.StringType()),
        T.StructField("log_path", T.StringType()),
        T.StructField("total_instances", T.LongType()),
    ]
)

TOOL_CALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("tool_call_id", T.StringType()),
    ]
)

HUNK = T.StructType(
    [
        T.StructField("old_start", T.LongType()),
        T.StructField("old_len", T.LongType()),
        T.StructField("new_start", T.LongType()),
        T.StructField("new_len", T.LongType()),
        T.StructField("lines", T.ArrayType(T.StringType())),
    ]
)

PATCH_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("hunks", T.ArrayType(HUNK)),
    ]
)
