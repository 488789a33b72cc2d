"""Whole jobs: trace ingest, prompts of failing tests, and the evaluation of patched runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schemas
from tracelake.functions.locals import DEFAULT_CUTOFF
from tracelake.functions.text import failure_summary, tool_result
from tracelake.operators import frames as frame_ops
from tracelake.operators import metrics, outcomes, render, source
from tracelake.session import work_folder
from tracelake.sources import readers, writers


@dataclass(frozen=True)
class ComparisonOptions:
    """Sizes of what a prompt shows."""

    context_lines: int = 8
    test_context_lines: int = 25
    max_context_files: int = frame_ops.CONTEXT_FILES
    max_tool_output_chars: int = 20000
    exec_path_limit: int = frame_ops.EXEC_PATH_LIMIT
    locals_cutoff: int = DEFAULT_CUTOFF
    stdlib_paths: Sequence[str] = ()


@dataclass(frozen=True)
class PromptTexts:
    """The fixed sections of the prompts."""

    intro: str
    instructions: str
    runtime_specific: str = ""
    patch_format: str = ""


@dataclass(frozen=True)
class Evaluation:
    """The tables of one evaluation."""

    outcomes: DataFrame
    verdicts: DataFrame
    records: DataFrame
    metrics: DataFrame


def ingest_traces(spark: SparkSession, base: str, path: str, instances: DataFrame | None = None) -> None:
    """Trace files below ``base`` as tables below ``path``.

    The JSON is parsed once, into ``parts``, and numbered into ``traces``, which also holds a row for each piece that
    cannot be read; errors and frames come from that table, which is what a lost executor reads again. Instances that cannot be used are
    listed in ``errors``, with ``instances`` also those without a trace file;
    they do not stop the job, and have no frames. Running it again changes nothing.
    """
    pieces = readers.read_pieces(spark, f"{base}/*/{readers.TRACE_FILE}")
    readers.store_traces(spark, pieces, f"{path}/parts")
    readers.stored_traces(spark, f"{path}/parts").drop("_problem", "piece").write.mode("overwrite").parquet(f"{path}/traces")
    traces = spark.read.parquet(f"{path}/traces")
    errors = readers.errors_of(traces)
    if instances is not None:
        errors = errors.unionByName(readers.absent_files(spark, base, instances))
    writers.write_errors(errors, f"{path}/errors")
    rows = frame_ops.explode_frames(readers.sound_traces(traces), ("instance_id", "trace_pos"))
    writers.write_frames(rows, f"{path}/frames")


def comparison_prompts(
    traces: DataFrame,
    frames: DataFrame,
    files: DataFrame,
    texts: PromptTexts,
    options: ComparisonOptions = ComparisonOptions(),
    keys: Sequence[str] = schemas.TRACE_KEY,
    file_keys: Sequence[str] = source.INSTANCE,
) -> DataFrame:
    """The prompts of both variants for each row of ``traces``, from its frames and sources.

    ``traces`` holds the key, ``nodeid``, ``exc_type`` and ``message``, and may hold ``has_trace`` and ``output``, the
    test log that tells what failed where there is no trace. For one prompt per instance pass the chosen traces, see
    ``chosen_traces``.
    """
    # A row per trace and file, from which files, focus and tests follow; the frames are not read again for them.
    spark, path = frames.sparkSession, work_folder(frames.sparkSession, "used-files")
    frame_ops.files_by_first_use(frame_ops.trace_context_frames(frames, keys), keys, "ord").write.parquet(path)
    listed = spark.read.parquet(path)
    focus = frame_ops.focus_test(listed, frame_ops.context_files(listed, keys, options.max_context_files), keys)
    # Instances without a trace go past the joins: their keys are null and meet nothing.
    no_trace = F.col(keys[-1]).isNull()
    bare, traces = traces.where(no_trace), traces.where(~no_trace)
    named = traces.select(*keys).join(focus, list(keys), "left")
    tests = source.testcase_source(named, files, options.test_context_lines, file_keys)
    calls = frames.where(F.col("kind") == "exec_path")
    paths = render.exec_path_text(calls, keys, options.exec_path_limit)
    has_trace = F.col("has_trace") if "has_trace" in traces.columns else F.lit(True)
    output = F.col("output") if "output" in traces.columns else F.lit("")
    summary = failure_summary(F.col("nodeid"), F.col("exc_type"), F.col("message"), output, has_trace)
    instances = (
        traces.join(paths, list(keys), "left")
        .join(tests.select(*keys, "testcase_source"), list(keys))
        .unionByName(
            bare.withColumns(
                {"execution_path": F.lit(None).cast("string"), "testcase_source": F.lit(source.NO_TESTCASE)}
            )
        )
        .withColumn("failure_summary", summary)
    )
    return render.build_prompts(instances, texts.intro, texts.instructions, texts.runtime_specific)


def debug_prompts(
    traces: DataFrame,
    frames: DataFrame,
    files: DataFrame,
    texts: PromptTexts,
    options: ComparisonOptions = ComparisonOptions(),
    keys: Sequence[str] = schemas.TRACE_KEY,
    file_keys: Sequence[str] = source.INSTANCE,
) -> DataFrame:
    """The debugging prompt of each trace as the parts of one text, see ``render.build_debug_prompts``."""
    kept = frame_ops.traceback_pipeline(
        frames.where(F.col("kind") == "frames"), options.stdlib_paths, options.locals_cutoff
    )
    shown = render.render_frames(kept, files, keys, options.context_lines, file_keys)
    sections: Mapping[str, str] = {
        "intro": texts.intro,
        "instructions": texts.instructions,
        "patch_format": texts.patch_format,
    }
    return render.build_debug_prompts(traces, shown, sections, keys)


def chosen_traces(
    logs: DataFrame,
    traces: DataFrame,
    keys: Sequence[str] = schemas.RUN_KEY,
    order: str = "trace_pos",
) -> DataFrame:
    """Each instance of ``logs`` (keys, ``output``) with its first trace and a flag telling whether it has one."""
    first = frame_ops.select_trace(traces, keys, order).withColumn("_found", F.lit(True))
    return logs.join(first, list(keys), "left").withColumn(
        "has_trace", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def tool_results(calls: DataFrame, options: ComparisonOptions = ComparisonOptions()) -> DataFrame:
    """Answers of tools (``name``, ``status``, ``output``) as the text a model is given, cut to the longest allowed."""
    text = tool_result(F.col("name"), F.col("status"), F.col("output"), options.max_tool_output_chars)
    return calls.withColumn("result", text)


def evaluate(runs: DataFrame, headers: DataFrame, path: str, keys: Sequence[str] = schemas.RUN_KEY) -> Evaluation:
    """Outcomes, verdicts, records and metrics of patched runs.

    Test logs are by far the largest column and are parsed once: the outcomes
    are written below ``path`` and everything else reads that small table.
    """
    columns = [c for c in runs.columns if c not in ("output", "patch")]
    judged = outcomes.outcomes(runs)
    small = judged.select(*columns, *schemas.OUTCOME.names, "run_skipped")
    small.write.mode("overwrite").parquet(f"{path}/outcomes")
    results = runs.sparkSession.read.parquet(f"{path}/outcomes")
    records = outcomes.normalize_records(results)
    variants = records.where(F.col("variant") != schemas.BASELINE)
    return Evaluation(
        outcomes=results,
        verdicts=outcomes.verdicts(results, keys),
        records=records,
        metrics=metrics.run_metrics(variants, headers),
    )
