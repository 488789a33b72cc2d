"""The registered queries. Each reads whole tables below ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schemas
from tracelake.functions import locals as local_functions
from tracelake.functions import text
from tracelake.functions.classify import classify_framework, parse_outcome
from tracelake.functions.paths import normalize_path
from tracelake.functions.predicates import captured_unittest, failing_tests_only, has_frames, not_conftest, testbed_only
from tracelake.operators import code_search, dataset, frames, metrics, outcomes, patches, render, rollup, source, transcripts
from tracelake.operators.late import FileRows, file_rows
from tracelake.plans import adapters, comparison, sql_functions
from tracelake.schemas import FRAME_KINDS
from tracelake.session import release, work_folder
from tracelake.sources import artifact_store, index_log, readers, source_store, writers
from tracelake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The key of a trace, and of a transcript, in the test tables.
KEY = ("trace_id",)
SESSION = ("session_id",)

# Parameters of single queries; the check SQL uses the same.
SYMBOLS = ("the", "eau", "The ", "ção", ".")
NODEID = "tests/test_core.py::test_7"
FUNCTION = "purchase"
SMALL_CAP = 3
INTRO, INSTRUCTIONS, RUNTIME, PATCH_FORMAT = "Fix the test.", "Return a diff.", "Use the trace.", "Only a diff."


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.assemble_traces(adapters.events(spark, d), KEY)


def _of_kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _frames(spark, d).where(F.col("kind") == kind)


def _files_of_kind(spark: SparkSession, d: str, *kinds: str) -> FileRows:
    """Frames of these kinds as rows with an address."""
    return adapters.event_files(
        spark, d, lambda events: frames.assemble_traces(events, KEY).where(F.col("kind").isin(*kinds))
    )


def _exec_path(spark: SparkSession, d: str) -> DataFrame:
    return frames.exec_path_pipeline(_of_kind(spark, d, "exec_path"), KEY)


def _traceback(spark: SparkSession, d: str) -> DataFrame:
    return frames.traceback_pipeline(_of_kind(spark, d, "frames"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return adapters.view(spark, d, "source_files")


# --- frames ------------------------------------------------------------------


@query
def exec_path_summary(spark: SparkSession, d: str) -> DataFrame:
    """Failing tests with the number of functions kept on their execution path."""
    kept = _exec_path(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("kept"))
    traces = adapters.view(spark, d, "traces")
    return traces.join(kept, list(KEY), "left").select(
        "trace_id", "nodeid", "exc_type", "message", F.coalesce("kept", F.lit(0)).alias("kept")
    )


@query
def assembled_frames(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d).select("trace_id", "kind", "pos", "file", "line", "func", F.col("locals")["k"].alias("k"))


@query
def exec_path_frames(spark: SparkSession, d: str) -> DataFrame:
    return _exec_path(spark, d)


@query
def exec_path_capped(spark: SparkSession, d: str) -> DataFrame:
    return frames.exec_path_pipeline(_of_kind(spark, d, "exec_path"), KEY, limit=SMALL_CAP)


@query
def leading_step_frames(spark: SparkSession, d: str) -> DataFrame:
    """The first step frames per trace; large traces in slices."""
    kept = _of_kind(spark, d, "step_frames").where(testbed_only()).select("trace_id", "pos", "file", "func", "line")
    return frames.leading_rows(kept, KEY, "pos", SMALL_CAP, rows_per_task=1 << 10)


@query
def traceback_frames(spark: SparkSession, d: str) -> DataFrame:
    return _traceback(spark, d).select("trace_id", "pos", "file", "line", "func", F.col("locals")["k"].alias("k"))


@query
def step_frames(spark: SparkSession, d: str) -> DataFrame:
    kept = frames.late_step_frames(_files_of_kind(spark, d, "step_frames"), KEY)
    return kept.select("trace_id", "pos", "file", "line", "func", F.col("locals")["k"].alias("k"))


@query
def filtered_trace_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.apply_trace_pipelines(_frames(spark, d), KEY).select(
        "trace_id", "kind", "pos", "file", "line", "func", F.col("locals")["k"].alias("k")
    )


@query
def dedup_by_file(spark: SparkSession, d: str) -> DataFrame:
    table = _files_of_kind(spark, d, *FRAME_KINDS)
    return frames.late_dedup(table, ("kind", "file"), KEY).select("trace_id", "kind", "pos", "file", "line", "func")


@query
def frame_pages(spark: SparkSession, d: str) -> DataFrame:
    """Frames as the elements of their arrays."""
    nested = frames.nest_frames(_frames(spark, d).withColumn("meta", F.create_map().cast("map<string,string>")), KEY)
    place = F.concat_ws(":", "frame.file", F.col("frame.line").cast("string"), "frame.func")
    return nested.select("trace_id", "kind", "ordinal", place.alias("place"), F.col("frame.meta").isNull().alias("no_meta"))


@query
def block_index(spark: SparkSession, d: str) -> DataFrame:
    return frames.block_index(_traceback(spark, d).select("trace_id", "pos", "file"), KEY)


@query
def error_location(spark: SparkSession, d: str) -> DataFrame:
    return frames.error_location(_files_of_kind(spark, d, "frames"), KEY)


@query
def select_trace(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "traces")
    adapters.view(spark, d, "traces").write.parquet(path)
    return frames.select_trace(file_rows(spark.read.parquet(path)), ("instance_id",), "ord")


@query
def find_trace(spark: SparkSession, d: str) -> DataFrame:
    return frames.find_trace(adapters.view(spark, d, "traces"), NODEID, ("instance_id",), "ord")


@query
def trace_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = _of_kind(spark, d, "frames").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    traces = adapters.view(spark, d, "traces").join(counts, list(KEY), "left")
    stats = frames.trace_stats(traces, F.coalesce("n", F.lit(0)))
    return stats.withColumn("avg_frames", F.round("avg_frames", 6))


@query
def exception_histogram(spark: SparkSession, d: str) -> DataFrame:
    histogram = frames.exception_histogram(adapters.view(spark, d, "traces"), "ord")
    return histogram.withColumn("pct", F.round("pct", 6))


@query
def file_line_map(spark: SparkSession, d: str) -> DataFrame:
    listed = frames.file_line_map(frames.trace_context_frames(_frames(spark, d), KEY), KEY, "ord")
    return listed.select("trace_id", "file", "line", "file_pos", "ord")


def _used_files(spark: SparkSession, d: str) -> DataFrame:
    return frames.files_by_first_use(frames.trace_context_frames(_frames(spark, d), KEY), KEY, "ord")


@query
def context_files(spark: SparkSession, d: str) -> DataFrame:
    return frames.context_files(_used_files(spark, d), KEY).select("trace_id", "file", "rank", "first_line", "n_lines")


@query
def files_to_read(spark: SparkSession, d: str) -> DataFrame:
    used = _used_files(spark, d)
    listed = frames.files_to_read(frames.context_files(used, KEY), used, KEY)
    return listed.select("trace_id", "file", F.col("read_order.group").alias("chosen_first"), F.col("read_order.rank").alias("rank"))


def _focus(spark: SparkSession, d: str) -> DataFrame:
    used = _used_files(spark, d)
    return frames.focus_test(used, frames.context_files(used, KEY), KEY)


@query
def focus_test(spark: SparkSession, d: str) -> DataFrame:
    return _focus(spark, d)


@query
def variable_changes(spark: SparkSession, d: str) -> DataFrame:
    return frames.variable_changes(_of_kind(spark, d, "step_frames"), "k", KEY)


@query
def failing_tests(spark: SparkSession, d: str) -> DataFrame:
    return adapters.view(spark, d, "test_reports").where(failing_tests_only(F.col("phase"), F.col("outcome")))


@query
def trace_failures(spark: SparkSession, d: str) -> DataFrame:
    """Captured failing tests per instance."""
    return metrics.num_failures(adapters.view(spark, d, "traces"), ("instance_id",))


# --- test logs, verdicts, metrics ----------------------------------------------


@query
def classify_frameworks(spark: SparkSession, d: str) -> DataFrame:
    scripts = adapters.view(spark, d, "eval_scripts")
    return scripts.select("instance_id", classify_framework(F.col("eval_script")).alias("framework"))


@query
def detect_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Frameworks from a cache of one brand's instances, the others from their commands."""
    scripts = adapters.view(spark, d, "eval_scripts")
    cache = scripts.where(F.col("brand") == "Brand#2").select("instance_id", F.lit("django").alias("framework"))
    return dataset.detect_framework(scripts, cache).select("instance_id", "framework")


@query
def parse_outcomes(spark: SparkSession, d: str) -> DataFrame:
    logs = adapters.view(spark, d, "test_outputs")
    return logs.select("instance_id", "variant", parse_outcome(F.col("output")).alias("o")).select(
        "instance_id", "variant", "o.*"
    )


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcomes(adapters.runs(adapters.view(spark, d, "test_outputs")))


@query
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select(
        "instance_id", "variant", "status", "failure_count", "ran_tests", "summary_line", "run_skipped"
    )


@query
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    results = _outcomes(spark, d).select(
        "instance_id", "variant", "recorded_at", "status", "failure_count", "run_skipped"
    )
    return outcomes.verdicts(results, ("instance_id",)).select("instance_id", "variant", "verdict")


@query
def records(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.normalize_records(_outcomes(spark, d)).select(
        "instance_id",
        "variant",
        "status",
        "failure_count",
        "ran_tests",
        "summary_line",
        "failure_reason",
        "raw_error_excerpt",
    )


def _index_records(spark: SparkSession, d: str) -> DataFrame:
    results = _outcomes(spark, d).withColumns(
        {"framework": F.lit("pytest"), "artifact_report_path": F.concat(F.lit("/reports/"), F.col("instance_id").cast("string"))}
    )
    return outcomes.build_records(results, recorded_at=F.timestamp_seconds(F.lit(0)))


@query
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per instance, its nested parts side by side."""
    return _index_records(spark, d).select(
        "instance_id",
        "framework",
        "artifact_report_path",
        "recorded_at",
        F.col("baseline.status").alias("baseline_status"),
        F.col("variants")["without_runtime"]["status"].alias("without_status"),
        F.col("variants")["without_runtime"]["failure_reason"].alias("without_reason"),
        F.col("variants")["with_runtime"]["status"].alias("with_status"),
        F.col("variants")["with_runtime"]["failure_reason"].alias("with_reason"),
    )


def _variant_records(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.normalize_records(_outcomes(spark, d)).where(F.col("variant") != schemas.BASELINE)


@query
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    counts = metrics.failure_reason_counts(_variant_records(spark, d), ())
    return metrics.ranked_reasons(counts, ())


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_counts(_variant_records(spark, d), ())


def _round_rates(df: DataFrame) -> DataFrame:
    return df.withColumn("success_rate", F.round("success_rate", 9)).withColumn(
        "failure_rate", F.round("failure_rate", 9)
    )


@query
def variant_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round_rates(metrics.variant_metrics(_variant_records(spark, d), ()))


@query
def rolled_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by run and variant, of each run and of all, added up from batches; the first batch is replaced later."""
    path = work_folder(spark, "counts")
    rows = _variant_records(spark, d)
    parts = [rows.where(F.col("instance_id") % 3 == n) for n in range(3)]
    early = parts[0].withColumns({"status": F.lit("failed"), "failure_reason": F.lit("early")})
    rollup.add_counts(rollup.count_batch(early), path, "early")
    for n, part in enumerate(parts):
        rollup.add_counts(rollup.count_batch(part, early if n == 0 else None), path, f"part-{n}")
    rolled = _round_rates(rollup.rollup_metrics(rollup.read_counts(spark, path)))
    return rolled.select("variant", "level", "total_instances", "success_count", "failure_count", "success_rate", "failure_rate")


def _header(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """A header row per run of the records."""
    return runs.select("run_id").distinct().select(
        "run_id", F.lit("orders").alias("dataset"), F.lit("test").alias("split"), F.lit("model").alias("model")
    )


def _count_text(column: str) -> Column:
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(F.array_sort(entries), ",")


def _flat_metrics(wide: DataFrame) -> DataFrame:
    """Run metrics, one row per variant, with the count maps as text."""
    parts = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.col(v).alias("m")) for v in schemas.VARIANTS]
    )
    long = wide.select("run_id", "dataset", "split", "model", F.inline(parts)).select(
        "run_id", "dataset", "split", "model", "variant", "m.*"
    )
    return _round_rates(long).withColumn("status_counts", _count_text("status_counts")).withColumn(
        "failure_reason_counts", _count_text("failure_reason_counts")
    )


@query
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _variant_records(spark, d)
    return _flat_metrics(metrics.run_metrics(rows, _header(spark, rows)))


def _collection(spark: SparkSession, d: str) -> DataFrame:
    scripts = adapters.view(spark, d, "eval_scripts").select(
        "instance_id", classify_framework(F.col("eval_script")).alias("framework")
    )
    runs = _outcomes(spark, d)
    return runs.join(scripts, "instance_id", "left").select(
        "instance_id",
        "variant",
        F.coalesce("framework", F.lit("unknown")).alias("framework"),
        "success",
        "error",
        F.coalesce("failure_count", F.lit(0)).alias("num_failures"),
    )


@query
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.collection_summary(_collection(spark, d))


@query
def failed_runs(spark: SparkSession, d: str) -> DataFrame:
    _, failed = outcomes.split_runs(_collection(spark, d))
    return failed.select("instance_id", "variant", "framework", "error")


@query
def run_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _outcomes(spark, d)
    return outcomes.error_records(rows, F.lit("RunError"), F.col("error"))


@query
def run_result_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _collection(spark, d).select(
        "success",
        "instance_id",
        "framework",
        F.concat(F.lit("/runs/"), F.col("instance_id").cast("string")).alias("trace_path"),
        "num_failures",
        "error",
        F.array("variant").alias("traces"),
    )
    return outcomes.run_result_records(rows)


@query
def failure_lines(spark: SparkSession, d: str) -> DataFrame:
    logs = adapters.view(spark, d, "test_outputs")
    return logs.select("instance_id", "variant", F.array_join(text.failure_lines(F.col("output")), "\n").alias("failure_lines"))


@query
def failure_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What failed in each baseline run: its chosen trace, or lines of its log."""
    chosen = frames.select_trace(adapters.view(spark, d, "traces"), ("instance_id",), "ord")
    logs = adapters.view(spark, d, "test_outputs").where(F.col("variant") == schemas.BASELINE)
    joined = logs.select("instance_id", "output").join(chosen, "instance_id", "left")
    return joined.select(
        "instance_id",
        text.failure_summary(
            F.col("nodeid"), F.col("exc_type"), F.col("message"), F.col("output"), F.col("nodeid").isNotNull()
        ).alias("failure_summary"),
    )


def _report_input(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select(
        "run_id",
        "instance_id",
        "variant",
        "status",
        "failure_count",
        "ran_tests",
        "summary_line",
        "run_skipped",
        "success",
        "error",
        "patch",
        F.lit("pytest").alias("framework"),
        (F.col("output") != "").alias("has_trace"),
    )


@query
def comparison_reports(spark: SparkSession, d: str) -> DataFrame:
    built = outcomes.build_reports(_report_input(spark, d), created_at=F.timestamp_seconds(F.lit(0)))
    return built.select(
        "instance_id",
        "framework",
        "created_at",
        F.col("baseline.trace_count").alias("trace_count"),
        F.col("baseline.outcome.status").alias("baseline_status"),
        F.col("with_runtime.run_skipped").alias("with_skipped"),
        F.col("with_runtime.run_result.error").alias("with_error"),
        F.col("patches")["llm_with_runtime"].alias("with_patch"),
        F.col("comparison")["without_runtime_verdict"].alias("without_verdict"),
        F.col("comparison")["with_runtime_verdict"].alias("with_verdict"),
    )


@query
def stored_report_records(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON, read back and turned into records."""
    path = work_folder(spark, "reports")
    writers.write_reports(outcomes.build_reports(_report_input(spark, d)), path)
    results = outcomes.report_results(readers.read_reports(spark, path, multi_line=False))
    return outcomes.normalize_records(results).select(
        F.col("instance_id").cast("bigint").alias("instance_id"),
        "variant",
        "status",
        "failure_count",
        "summary_line",
        "failure_reason",
        "raw_error_excerpt",
    )


@query
def stored_index_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Index records written as a table, read back and turned into run metrics."""
    path = work_folder(spark, "index")
    rows = _index_records(spark, d)
    header = _header(spark, rows).withColumn("completed_at", F.lit(None).cast("string"))
    writers.write_run_index(rows, header, path)
    long = readers.index_records(spark.read.parquet(f"{path}/records"))
    headers = writers.latest_headers(spark.read.parquet(f"{path}/headers"))
    return _flat_metrics(metrics.run_metrics(long, headers))


@query
def appended_index_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Index records appended in batches, some of them again, with a lost batch and a compaction in between."""
    path = work_folder(spark, "index-log")
    rows = _index_records(spark, d)
    header = _header(spark, rows).withColumn("completed_at", F.lit(None).cast("string"))
    index_log.append_headers(header, path, "begun")
    parts = [rows.where(F.col("instance_id") % 3 == n) for n in range(3)]
    # An earlier attempt knew the baselines alone; a lost one left a folder without a commit.
    index_log.append_records(parts[0].withColumn("variants", F.create_map().cast(rows.schema["variants"].dataType)), path, "early")
    parts[1].withColumn("run_id", F.lit("lost")).write.parquet(f"{path}/records/batch=lost")
    for n, part in enumerate(parts):
        index_log.append_records(part, path, f"part-{n}")
        if n == 1:
            index_log.compact(spark, path, "compacted")
    index_log.append_records(parts[2], path, "part-2")
    index_log.finalise_runs(spark, path, [r["run_id"] for r in header.select("run_id").distinct().collect()], "done")
    long = readers.index_records(index_log.read_records(spark, path))
    return _flat_metrics(metrics.run_metrics(long, index_log.read_headers(spark, path)))


# --- dataset joins ----------------------------------------------------------------


@query
def match_predictions(spark: SparkSession, d: str) -> DataFrame:
    return dataset.match_predictions(
        adapters.view(spark, d, "instances"), adapters.view(spark, d, "predictions")
    ).select("instance_id", "c_custkey", "ord", "model_patch")


@query
def missing_predictions(spark: SparkSession, d: str) -> DataFrame:
    return dataset.missing_predictions(
        adapters.view(spark, d, "instances"), adapters.view(spark, d, "predictions")
    )


@query
def select_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances that have a prediction, outside one repository."""
    ids = adapters.view(spark, d, "predictions").select("instance_id")
    return dataset.select_instances(adapters.view(spark, d, "instances"), ids, ["django/django"])


@query
def exclude_repos(spark: SparkSession, d: str) -> DataFrame:
    """Instances outside the repositories that hold a machinery customer's instance."""
    instances = adapters.view(spark, d, "instances")
    repo = F.regexp_replace(F.regexp_extract("instance_id", r"^(.*)-[^-]*$", 1), "__", "/")
    repos = instances.where((F.col("segment") == "MACHINERY") & F.col("instance_id").startswith("sympy")).select(repo.alias("repo"))
    return dataset.exclude_repo_table(instances, repos.distinct())


# --- source text --------------------------------------------------------------------


@query
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return source.source_lines(_files(spark, d), ())


@query
def source_context(spark: SparkSession, d: str) -> DataFrame:
    shown = source.with_source_context(_frames(spark, d), _files(spark, d), 2, ())
    return shown.select("trace_id", "pos", "file", "line", "context")


@query
def stored_source_context(spark: SparkSession, d: str) -> DataFrame:
    """Source context of three instances that share all of their files, which are stored once."""
    path = work_folder(spark, "sources")
    instances = F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])).alias("instance_id")
    files = _files(spark, d).select(instances, "path", "content")
    source_store.add_sources(files.where("instance_id = 0"), path)
    source_store.add_sources(files.where("instance_id > 0"), path)
    shown = source_store.with_stored_context(_frames(spark, d).withColumn("instance_id", F.col("trace_id") % 3), path, 2)
    return shown.select("trace_id", "pos", "file", "line", "context")


@query
def testcase_source(spark: SparkSession, d: str) -> DataFrame:
    traces = adapters.view(spark, d, "traces").select("trace_id")
    focus = traces.join(_focus(spark, d), list(KEY), "left")
    return source.testcase_source(focus, _files(spark, d), 25, ()).select("trace_id", "testcase_source")


@query
def search_symbol(spark: SparkSession, d: str) -> DataFrame:
    return source.search_symbol(_files(spark, d), SYMBOLS, ())


def _code_index(spark: SparkSession, d: str) -> code_search.CodeIndex:
    return code_search.build_index(spark, _files(spark, d), work_folder(spark, "code-index"), ())


def _benchmark_words(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, word): the distinct words of every benchmark text."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    words = F.array_distinct(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1))
    return items.select("item_id", F.explode(words).alias("word")).where(F.col("word") != "")


@query
def search_requests(spark: SparkSession, d: str) -> DataFrame:
    """Searches for the longest word of every benchmark text, the first of equals."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    longer = lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)
    word = F.aggregate(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), F.lit(""), longer)
    requests = items.select(F.col("item_id").alias("request_id"), word.alias("pattern"))
    hits = code_search.pattern_requests(spark, _code_index(spark, d), requests)
    return hits.select("request_id", F.col("pattern").alias("symbol"), "path", "line_no")


@query
def search_words(spark: SparkSession, d: str) -> DataFrame:
    """Searches for every distinct word of three letters and more of all benchmark texts: the lines that hold it."""
    words = _benchmark_words(spark, d).where(F.length("word") >= code_search.GRAM).select(F.col("word").alias("pattern"))
    return code_search.pattern_counts(spark, _code_index(spark, d), words).select(F.col("pattern").alias("symbol"), "hits")


@query
def search_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Regular expressions made of every benchmark text's longer words: four letters, up to two more, and the end."""
    letters = F.regexp_like("word", F.lit("^[A-Za-z]{8,}$"))
    pattern = F.concat(F.substring("word", 1, 4), F.lit("[a-z]?[a-z]?"), F.substring("word", -2, 2))
    asked = _benchmark_words(spark, d).where(letters).select(pattern.alias("pattern"), F.lit(True).alias("is_regex"))
    hits = code_search.search_patterns(spark, _code_index(spark, d), asked)
    return hits.select("pattern", "path", "line_no")


@query
def search_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Searches for the conversations' roles and for blanks, with their hit counts."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    requests = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(F.col("role") == "system", " ").otherwise(F.col("role")).alias("symbol"),
    )
    hits = source.symbol_hits(_files(spark, d), requests, ())
    return source.search_status(requests, hits, ())


@query
def project_tree(spark: SparkSession, d: str) -> DataFrame:
    return source.project_tree(_files(spark, d), ())


@query
def open_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range request per tracer event, some of them out of range or outside the project."""
    requests = adapters.view(spark, d, "trace_events").select(
        F.col("seq").alias("request_id"),
        F.col("file").alias("path"),
        (F.col("line") - 3).alias("start_line"),
        (F.col("line") + 2).alias("end_line"),
    )
    return source.open_ranges(requests, _files(spark, d), ())


@query
def normalized_paths(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    form = (F.col("event_id") % 7).cast("int")
    raw = (
        F.when(form == 0, F.concat(F.lit("/testbed/a/../pkg/f"), number))
        .when(form == 1, F.concat(F.lit("pkg//./f"), number))
        .when(form == 2, F.concat(F.lit("/etc/f"), number))
        .when(form == 3, F.concat(F.lit("../../f"), number))
        .when(form == 4, F.lit("  "))
        .when(form == 5, F.lit(" /testbed "))
        .otherwise(F.concat(F.lit("/testbed/../f"), number))
    )
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", normalize_path(raw).alias("p")).select("event_id", "p.path", "p.error")


@query
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as JSON strings, non-ASCII kept."""
    documents = spark.read.parquet(f"{d}/documents.parquet")
    return documents.select("doc_id", local_functions.json_quote(F.col("text"), ascii_only=False).alias("json_text"))


@query
def serialized_locals(spark: SparkSession, d: str) -> DataFrame:
    """Texts as values of a variable, in the ASCII form that is cut."""
    documents = spark.read.parquet(f"{d}/documents.parquet")
    values = local_functions.serialize_locals(F.create_map(F.lit("text"), F.col("text")))
    return documents.select("doc_id", values["text"].alias("serialized"))


@query
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    documents = spark.read.parquet(f"{d}/documents.parquet")
    return documents.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.preview(F.col("text")).alias("preview"))


# --- patches and transcripts ---------------------------------------------------------


@query
def extract_diffs(spark: SparkSession, d: str) -> DataFrame:
    return patches.extract_patches(adapters.messages(spark, d)).select("session_id", "turn", "patch")


@query
def explode_hunks(spark: SparkSession, d: str) -> DataFrame:
    hunks = patches.explode_hunks(adapters.view(spark, d, "patches"), ["patch_id"])
    return hunks.withColumn("lines", F.array_join("lines", "\n"))


@query
def patch_lines(spark: SparkSession, d: str) -> DataFrame:
    hunks = patches.explode_hunks(adapters.view(spark, d, "patches"), ["patch_id"])
    return patches.patch_lines(hunks, ["patch_id"])


@query
def patch_errors(spark: SparkSession, d: str) -> DataFrame:
    return patches.patch_errors(adapters.view(spark, d, "patches"), ["patch_id"])


@query
def assemble_diffs(spark: SparkSession, d: str) -> DataFrame:
    return patches.assemble_patches(adapters.view(spark, d, "patches")).select("patch_id", "diff")


@query
def render_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.render_transcripts(adapters.messages(spark, d))


@query
def transcript_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every kilobyte of every session's stored text, as a digest of its bytes."""
    path = work_folder(spark, "transcripts")
    artifact_store.write_parts(transcripts.render_transcripts(adapters.messages(spark, d)), path, SESSION)
    sizes = artifact_store.text_sizes(spark, path, SESSION).where("total_bytes > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_bytes") - 1, F.lit(1024).cast("long"))).alias("first_byte")
    asked = sizes.select("session_id", first, F.lit(1024).alias("n_bytes"))
    asked = asked.withColumn("request_id", F.struct("session_id", "first_byte"))
    found = artifact_store.read_stretches(spark, path, asked, SESSION)
    return found.select("request_id.session_id", "request_id.first_byte", F.sha2(F.hex("bytes").cast("binary"), 256).alias("digest"))


@query
def transcript_pages(spark: SparkSession, d: str) -> DataFrame:
    """The parts and the length of each session's text."""
    parts = transcripts.render_transcripts(adapters.messages(spark, d))
    return parts.groupBy("session_id").agg(
        (F.max("ordinal") + 1).alias("parts"), F.sum(F.length("text")).alias("chars")
    )


@query
def resolve_patches(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.resolve_patches(adapters.messages(spark, d))


@query
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = transcripts.validate_tool_calls(transcripts.parse_tool_calls(adapters.messages(spark, d)))
    return calls.select(
        "session_id",
        "turn",
        "variant",
        "tool_call_id",
        "name",
        F.array_join(
            F.array_sort(F.transform(F.map_entries("arguments"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","
        ).alias("arguments"),
        "error",
        "status",
    )


@query
def tool_call_results(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.join_tool_results(adapters.messages(spark, d)).select(
        "session_id", "turn", "tool_call_id", "name", "result_turn", "result"
    )


@query
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.session_stats(adapters.messages(spark, d))


@query
def tool_stats(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.tool_stats(adapters.messages(spark, d))


@query
def tool_result_texts(spark: SparkSession, d: str) -> DataFrame:
    messages = spark.read.parquet(f"{d}/conversations.parquet")
    answers = messages.select(
        "conv_id", "turn", F.lit("open_file").alias("name"), F.col("role").alias("status"), F.col("text").alias("output")
    )
    return comparison.tool_results(answers).select("conv_id", "turn", "result")


# --- prompts ---------------------------------------------------------------------------


@query
def execution_traces(spark: SparkSession, d: str) -> DataFrame:
    traces = adapters.view(spark, d, "traces").select("trace_id")
    return render.execution_traces(traces, _of_kind(spark, d, "exec_path"), KEY)


@query
def render_frames(spark: SparkSession, d: str) -> DataFrame:
    return render.render_frames(_traceback(spark, d), _files(spark, d), KEY, 2, ())


@query
def granular_frames(spark: SparkSession, d: str) -> DataFrame:
    traces = adapters.view(spark, d, "traces")
    steps = _of_kind(spark, d, "step_frames")
    return render.granular_frames(traces, steps, _files(spark, d), FUNCTION, KEY, 1, ())


@query
def exception_texts(spark: SparkSession, d: str) -> DataFrame:
    traces = adapters.view(spark, d, "traces")
    return traces.select("trace_id", text.exception_text(F.col("exc_type"), F.col("message")).alias("exception"))


TEXTS = comparison.PromptTexts(INTRO, INSTRUCTIONS, RUNTIME, PATCH_FORMAT)


@query
def chosen_prompts(spark: SparkSession, d: str) -> DataFrame:
    """One prompt per instance and variant: of its chosen trace, or of its log where it has none."""
    logs = adapters.view(spark, d, "test_outputs").where(F.col("variant") == schemas.BASELINE)
    traces = adapters.view(spark, d, "traces")
    chosen = comparison.chosen_traces(logs.select("instance_id", "output"), traces, ("instance_id",), "ord")
    prompts = comparison.comparison_prompts(
        chosen, _frames(spark, d), _files(spark, d), TEXTS, keys=KEY, file_keys=()
    )
    return prompts.select("instance_id", "variant", "prompt")


@query
def comparison_prompts(spark: SparkSession, d: str) -> DataFrame:
    traces = adapters.view(spark, d, "traces").select("trace_id", "nodeid", "exc_type", "message")
    prompts = comparison.comparison_prompts(
        traces, _frames(spark, d), _files(spark, d), TEXTS, keys=KEY, file_keys=()
    )
    return prompts.select("trace_id", "variant", "prompt")


@query
def debug_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with the rendered frames, as the parts of one text."""
    options = comparison.ComparisonOptions(context_lines=2)
    prompts = comparison.debug_prompts(
        adapters.view(spark, d, "traces"), _frames(spark, d), _files(spark, d), TEXTS, options, KEY, ()
    )
    return prompts.select("trace_id", "ordinal", "text")


@query
def evaluated_runs(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation job: verdicts next to the records they belong to."""
    runs = adapters.runs(adapters.view(spark, d, "test_outputs"))
    result = comparison.evaluate(runs, _header(spark, runs), work_folder(spark, "evaluation"))
    records = result.records.select("run_id", "instance_id", "variant", "failure_reason", "raw_error_excerpt")
    return result.verdicts.join(records, ["run_id", "instance_id", "variant"]).drop("run_id")


@query
def evaluated_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of the whole evaluation job."""
    runs = adapters.runs(adapters.view(spark, d, "test_outputs"))
    return _flat_metrics(comparison.evaluate(runs, _header(spark, runs), work_folder(spark, "evaluation")).metrics)


# --- documents ---------------------------------------------------------------------------


def _flat_traces(traces: DataFrame) -> DataFrame:
    place = [
        F.array_join(
            F.transform(
                kind,
                lambda f: F.concat_ws("|", f["file"], f["line"].cast("string"), f["func"], f["locals"]["k"]),
            ),
            ";",
        ).alias(kind)
        for kind in schemas.FRAME_KINDS
    ]
    return traces.select("instance_id", "trace_pos", "nodeid", "exc_type", "message", *place)


@query
def strict_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces of well-formed documents, those with a bad frame left out."""
    return _flat_traces(readers.sound_documents(adapters.view(spark, d, "trace_documents")))


@query
def lenient_traces(spark: SparkSession, d: str) -> DataFrame:
    return _flat_traces(readers.parse_traces(adapters.view(spark, d, "trace_documents"), strict=False))


@query
def trace_errors(spark: SparkSession, d: str) -> DataFrame:
    return readers.trace_errors(adapters.view(spark, d, "trace_documents"))


@query
def document_frames(spark: SparkSession, d: str) -> DataFrame:
    """All frames of the documents, one row each."""
    parsed = readers.parse_traces(adapters.view(spark, d, "trace_documents"), strict=False)
    exploded = frames.explode_frames(parsed, ("instance_id", "trace_pos"))
    return exploded.select("instance_id", "trace_pos", "kind", "pos", "file", "line", "func")


# --- files of the artifact layout --------------------------------------------------------

PART = "part-*"
# Rows that one document of a list is made of.
LIST_ROWS = 1000


def _log_files(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder per benchmark item with its text as the log, and these items with as many that have no folder."""
    base = work_folder(spark, "logs")
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    items.select(F.col("item_id").alias("instance_id"), "text").write.partitionBy("instance_id").text(base)
    known = items.select(F.col("item_id").cast("string").alias("instance_id"))
    return base, known.unionByName(known.select(F.concat(F.lit("absent-"), "instance_id").alias("instance_id")))


@query
def file_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The logs of instances, read from their folders."""
    base, instances = _log_files(spark, d)
    return readers.read_test_outputs(spark, base, instances, PART)


@query
def file_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances that are listed, and whether they have a file."""
    base, instances = _log_files(spark, d)
    listed = readers.list_instances(spark, base).withColumn("listed", F.lit(True))
    found = readers.trace_exists(spark, base, instances, PART)
    return found.join(listed, "instance_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


@query
def file_sources(spark: SparkSession, d: str) -> DataFrame:
    """Project snapshots of three instances, read back from their folders: a file per document."""
    base = work_folder(spark, "snapshots")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for n in range(3):
        part = docs.where((F.col("doc_id") % 3 == n) & F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), "text")
        writers.write_texts_by(part, "doc", f"{base}/i{n}/{readers.PROJECT_FOLDER}/src")
    found = readers.read_source_tree(spark, base)
    doc = F.regexp_extract("path", "^/testbed/src/doc=([0-9]+)/part-", 1).cast("bigint")
    return found.select("instance_id", doc.alias("doc_id"), "content")


def _documents_of(rows: DataFrame, number: Column, entry: Column, head: Column, tail: str, path: str, codec: str = "none") -> None:
    """JSON documents of ``LIST_ROWS`` entries each, every one on one line in a folder of its own."""
    entries = F.array_join(F.array_sort(F.collect_list(entry)), ", ")
    grouped = rows.groupBy(F.floor(number / LIST_ROWS).alias("part")).agg(entries.alias("_entries"))
    grouped.select("part", F.concat(head, "_entries", F.lit(tail)).alias("value")).write.option("compression", codec).partitionBy("part").text(path)


@query
def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Run indexes written as JSON documents, and the records read from them."""
    path = work_folder(spark, "index-documents")
    rows = _index_records(spark, d)
    kept = rows.select("instance_id", "framework", "recorded_at", "artifact_report_path", "baseline", "variants")
    record = F.to_json(F.struct(F.col("instance_id").cast("string").alias("instance_id"), *kept.columns[1:]))
    head = F.concat(F.lit('{"schema_version": 1, "run_id": "run-'), F.col("part").cast("string"), F.lit('", "records": ['))
    # As texts, documents would be several times as large as the tables.
    _documents_of(kept, F.col("instance_id"), record, head, '], "log_path": "}"}', path, "gzip")
    release(spark)
    _, records = readers.read_run_index(spark, path)
    return records.select(
        "run_id",
        F.col("instance_id").cast("bigint").alias("instance_id"),
        F.col("variants")["without_runtime"]["status"].alias("without_status"),
        F.col("variants")["with_runtime"]["status"].alias("with_status"),
    )


@query
def file_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON lists of one line, and read back."""
    path = work_folder(spark, "predictions.json") + ".json"
    rows = adapters.view(spark, d, "predictions")
    _documents_of(rows, F.col("ord"), F.to_json(F.struct("instance_id", "ord", "model_patch")), F.lit("["), "]", path)
    return readers.read_predictions(spark, path).select("instance_id", "ord", "model_patch")


@query
def file_framework_cache(spark: SparkSession, d: str) -> DataFrame:
    """Frameworks read from cache files with a note in each."""
    path = work_folder(spark, "caches")
    scripts = adapters.view(spark, d, "eval_scripts")
    rows = scripts.select("instance_id", classify_framework(F.col("eval_script")).alias("framework"))
    entry = F.concat(F.lit('"'), F.col("instance_id").cast("string"), F.lit('": "'), F.col("framework"), F.lit('"'))
    _documents_of(rows, F.col("instance_id"), entry, F.lit('{"_comment": "made", '), "}", path)
    found = readers.read_framework_cache(spark, f"{path}/*/{PART}")
    return found.select(F.col("instance_id").cast("bigint").alias("instance_id"), "framework")


@query
def stored_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of runs, written and read back."""
    path = work_folder(spark, "errors")
    writers.write_errors(run_errors(spark, d), path)
    return spark.read.json(path).select(F.col("instance_id").cast("bigint").alias("instance_id"), "error_type", "error_message")


@query
def stored_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of runs, written and read back."""
    path = work_folder(spark, "metrics")
    writers.write_metrics(run_metrics(spark, d), path)
    return spark.read.json(path).select(*run_metrics(spark, d).columns)


@query
def stored_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Patches as an artifact table, written and read back."""
    path = work_folder(spark, "artifacts")
    patches_of = adapters.view(spark, d, "patches").select(F.col("patch_id").alias("instance_id"), F.lit("patch").alias("kind"), F.col("patch").alias("text"))
    writers.write_artifacts(patches_of, path)
    return spark.read.parquet(path).select("instance_id", "kind", "text")


@query
def captured_failures(spark: SparkSession, d: str) -> DataFrame:
    """Events of unittest runs that capture a failure."""
    events = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        F.element_at(F.array(*map(F.lit, ("error", "failure", "subtest", "success", "skip"))), (F.col("event_id") % 5 + 1).cast("int")).alias("event"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("traceback"),
    )
    return events.where(captured_unittest(F.col("event"), F.col("traceback")))


@query
def traces_with_frames(spark: SparkSession, d: str) -> DataFrame:
    """Traces that captured any frame."""
    parsed = readers.parse_traces(adapters.view(spark, d, "trace_documents"), strict=False)
    return parsed.where(has_frames(F.col("frames"))).select("instance_id", "trace_pos", F.size("frames").alias("n"))


@query
def custom_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Own steps in a pipeline: a predicate, a function of frames, and locals cut to a few characters."""
    steps = [F.col("line") % 2 == 0, lambda df: frames.cap_frames(df, 4, KEY), not_conftest()]
    kept = frames.frame_pipeline(_of_kind(spark, d, "step_frames"), steps, cutoff=3)
    return kept.select("trace_id", "pos", "file", "line", "func", F.col("locals")["k"].alias("k"))


# --- SQL functions -------------------------------------------------------------------------


@query
def sql_exec_path(spark: SparkSession, d: str) -> DataFrame:
    """Execution paths from a table function."""
    sql_functions.register_pipelines(spark, _frames(spark, d), "event_frames", KEY)
    return spark.sql(f"SELECT * FROM event_frames_exec_path({SMALL_CAP})")


@query
def sql_step_frames(spark: SparkSession, d: str) -> DataFrame:
    """Step frames from a table function, filtered once more by a scalar one."""
    sql_functions.register_filters(spark, "frame_")
    sql_functions.register_pipelines(spark, _frames(spark, d), "event_frames", KEY)
    return spark.sql(
        "SELECT trace_id, pos, file, line, func, locals['k'] AS k FROM event_frames_step_frames() WHERE frame_not_conftest(file)"
    )


# --- streams -------------------------------------------------------------------------------


def _arriving(spark: SparkSession, d: str) -> Callable[[str], DataFrame]:
    """Reads a table as a stream of its files."""

    def read(table: str) -> DataFrame:
        schema = spark.read.parquet(f"{d}/{table}.parquet").schema
        return spark.readStream.schema(schema).parquet(f"{d}/{table}*.parquet")

    return read


def _order_stream(spark: SparkSession, d: str) -> DataFrame:
    """The runs as they arrive."""
    return adapters.runs(adapters.over(spark, adapters.VIEWS["test_outputs"], _arriving(spark, d)))


@query
def stream_records(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "stream-records")
    stream = jobs.record_stream(_order_stream(spark, d))
    jobs.write_stream(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(
        "instance_id", "variant", "status", "failure_count", "failure_reason", "raw_error_excerpt"
    )


@query
def stream_report_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of reports that arrive as files."""
    path = work_folder(spark, "stream-reports")
    writers.write_reports(outcomes.build_reports(_report_input(spark, d)), f"{path}/reports")
    arriving = spark.readStream.schema(schemas.REPORT).json(f"{path}/reports/run_id=*")
    jobs.write_stream(jobs.report_stream(arriving), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(
        F.col("instance_id").cast("bigint").alias("instance_id"), "variant", "status", "failure_count", "failure_reason"
    )


@query
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "stream-metrics")
    arriving = jobs.record_stream(_order_stream(spark, d)).where(F.col("variant") != schemas.BASELINE)
    jobs.write_stream(arriving, f"{path}/out", f"{path}/state").awaitTermination()
    counts = jobs.record_counts(spark.read.parquet(f"{path}/out"))
    return _round_rates(jobs.metrics_of_counts(counts, ()))


@query
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of runs that arrive more than once: an early, wrong result each, the run, and the early one again."""
    path = work_folder(spark, "stream-counts")
    runs = outcomes.normalize_records(_outcomes(spark, d)).select("run_id", "instance_id", "variant", "status", "failure_reason", "recorded_at")
    early = runs.withColumns(
        {
            "status": F.lit("failed"),
            "failure_reason": F.lit("early"),
            "recorded_at": F.col("recorded_at").cast("timestamp") - F.expr("INTERVAL 1 DAY"),
        }
    )
    for part in (early, runs.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), early):
        part.write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(early.schema).parquet(f"{path}/in")
    jobs.write_changes(jobs.count_changes(arriving), f"{path}/out", f"{path}/state").awaitTermination()
    counts = jobs.sum_of_changes(spark.read.parquet(f"{path}/out"))
    return counts.select("variant", "status", "failure_reason", "n")


@query
def stream_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of arriving tracer events."""
    path = work_folder(spark, "stream-frames")
    events = adapters.over(spark, adapters.VIEWS["trace_events"], _arriving(spark, d))
    jobs.write_stream(frames.assemble_traces(events, KEY), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("trace_id", "kind", "pos", "file", "line", "func")
