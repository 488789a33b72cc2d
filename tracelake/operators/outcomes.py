"""Run outcomes, verdicts, index records and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.classify import classify_failure_reason, run_outcome, verdict
from tracelake.functions.text import excerpt, first_non_empty, utc_iso
from tracelake.schemas import BASELINE, RUN_KEY, STATUSES, VARIANTS, WITH_RUNTIME, WITHOUT_RUNTIME

# Where a run left its artifacts, as far as they are known.
BASELINE_PATHS = ("trace_path", "test_output_path")
VARIANT_PATHS = ("prompt_path", "response_path", "patch_path", "test_output_path")
RECORD_FIELDS = ("framework", "artifact_report_path")
SCHEMA_VERSION = 1
STATUS_BITS = 3


def outcomes(runs: DataFrame) -> DataFrame:
    """Runs (patch, success, error, output) with their outcome columns.

    A baseline run carries no patch and is judged by its log alone.
    """
    patch = F.when(F.col("variant") == BASELINE, F.lit("none needed")).otherwise(F.col("patch"))
    success = F.when(F.col("variant") == BASELINE, F.lit(True)).otherwise(F.col("success"))
    judged = runs.withColumn("_o", run_outcome(patch, success, F.col("error"), F.col("output")))
    return judged.select(*runs.columns, "_o.*")


def run_order(results: DataFrame) -> Column:
    """A number that is highest on the latest run: by ``recorded_at``, and by status among equals."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0)).cast("bigint")
    if "recorded_at" not in results.columns:
        return code
    at = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(0))
    return F.shiftleft(at, STATUS_BITS) + code


def verdicts(results: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """The verdict of each variant run against the baseline of its instance.

    One aggregate per instance instead of a self-join: the rows of an instance
    are folded into one row on the map side, and unfolded after the shuffle. Its
    buffers are numbers, so it is a hash aggregate. Of a run that was delivered
    more than once the latest counts, by ``recorded_at`` if there is one.
    """
    ordered = results.withColumn("_order", run_order(results))

    def latest(name: str) -> list[Column]:
        at = F.when(F.col("variant") == name, F.col("_order"))
        return [
            F.max(at).alias(f"_{name}_order"),
            F.max_by("failure_count", at).alias(f"_{name}_failures"),
            F.max_by("run_skipped", at).alias(f"_{name}_skipped"),
        ]

    def status(name: str) -> Column:
        code = F.col(f"_{name}_order").bitwiseAND((1 << STATUS_BITS) - 1).cast("int")
        return F.get(F.array(*map(F.lit, STATUSES)), code - 1)

    folded = ordered.groupBy(*keys).agg(*[c for name in (BASELINE, *VARIANTS) for c in latest(name)])

    def judged(name: str) -> Column:
        result = verdict(
            status(BASELINE),
            F.col(f"_{BASELINE}_failures"),
            status(name),
            F.col(f"_{name}_failures"),
            F.col(f"_{name}_skipped"),
        )
        row = F.struct(F.lit(name).alias("variant"), status(name).alias("status"), result.alias("verdict"))
        return F.when(F.col(f"_{name}_order").isNotNull(), row)

    return folded.select(*keys, F.inline(F.array_compact(F.array(*[judged(v) for v in VARIANTS]))))


def normalize_records(results: DataFrame, missing_status: Column | None = None) -> DataFrame:
    """Outcome rows as index records: defaults, failure reason and an error excerpt.

    Works on (status, failure_count, ran_tests, summary_line, error, traceback).
    A baseline without a status is ``unknown``, a variant is ``not_run``.
    """
    default = missing_status
    if default is None:
        default = F.when(F.col("variant") == BASELINE, "unknown").otherwise("not_run")
    status = F.coalesce("status", default)
    summary = F.coalesce("summary_line", F.lit(""))
    error = F.coalesce("error", F.lit(""))
    traceback = F.coalesce(F.col("traceback"), F.lit("")) if "traceback" in results.columns else F.lit("")
    return (
        results.withColumn("failure_reason", classify_failure_reason(status, summary, error))
        .withColumn("raw_error_excerpt", excerpt(first_non_empty(error, summary, traceback)))
        .withColumn("status", status)
        .withColumn("summary_line", summary)
    )


def build_records(results: DataFrame, keys: Sequence[str] = RUN_KEY, recorded_at: Column | None = None) -> DataFrame:
    """One row per instance: the baseline record, a map of variant records and the time.

    ``framework`` and ``artifact_report_path`` go into the record where they are known. Of a run that was delivered more
    than once the latest counts.
    """
    order = run_order(results)
    fields = ("status", "failure_count", "ran_tests", "summary_line", "failure_reason", "raw_error_excerpt")

    def of(name: str) -> Column:
        record = F.struct(*fields, *_known(results, BASELINE_PATHS if name == BASELINE else VARIANT_PATHS))
        return F.max_by(record, F.when(F.col("variant") == name, F.col("_order")))

    return normalize_records(results.withColumn("_order", order)).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in _known(results, RECORD_FIELDS)],
        of(BASELINE).alias("baseline"),
        F.create_map(
            F.lit(WITHOUT_RUNTIME), of(WITHOUT_RUNTIME), F.lit(WITH_RUNTIME), of(WITH_RUNTIME)
        ).alias("variants"),
    ).withColumn("recorded_at", utc_iso(recorded_at))


def report_results(reports: DataFrame) -> DataFrame:
    """Report documents as one row per instance and variant.

    A missing section still gives a row, as the record of an instance must.
    """
    known = {name: reports.schema[name].dataType.names for name in (BASELINE, *VARIANTS)}

    def section(name: str) -> Column:
        part = F.col(name)
        return F.struct(
            F.lit(name).alias("variant"),
            part["outcome"]["status"].alias("status"),
            part["outcome"]["failure_count"].alias("failure_count"),
            part["outcome"]["ran_tests"].alias("ran_tests"),
            part["outcome"]["summary_line"].alias("summary_line"),
            part["run_result"]["error"].alias("error"),
            part["run_result"]["traceback"].alias("traceback"),
            *[
                (part[path] if path in known[name] else F.lit(None).cast("string")).alias(path)
                for path in dict.fromkeys(BASELINE_PATHS + VARIANT_PATHS)
            ],
        )

    keep = [c for c in ("run_id", "instance_id", "framework") if c in reports.columns]
    return reports.select(*keep, F.inline(F.array(section(BASELINE), *[section(v) for v in VARIANTS])))


def run_result_records(runs: DataFrame) -> DataFrame:
    """Run results as JSON: no traces, and no fields that are null."""
    kept = [c for c in runs.columns if c != "traces"]
    return runs.select("instance_id", F.to_json(F.struct(*kept)).alias("record"))


def build_reports(
    results: DataFrame, keys: Sequence[str] = RUN_KEY, created_at: Column | None = None
) -> DataFrame:
    """One report row per instance: runs, outcomes, patches and verdicts.

    ``results`` holds the outcome columns with ``patch``, ``success``, ``error``,
    ``framework`` and, on the baseline, ``has_trace`` and the reference patch.
    """
    outcome = F.struct("status", "failure_count", "ran_tests", "summary_line")
    run = F.struct(
        "success",
        F.col("instance_id").cast("string").alias("instance_id"),
        "framework",
        *_known(results, ("trace_path", "num_failures", "runtime")),
        "error",
        *_known(results, ("traceback", "test_output_path")),
    )
    paths = _known(results, dict.fromkeys(BASELINE_PATHS + VARIANT_PATHS))
    row = F.struct(
        outcome.alias("outcome"), run.alias("run_result"), "run_skipped", "patch", "framework", "has_trace", *paths
    )

    def of(name: str) -> Column:
        return F.max_by(row, F.when(F.col("variant") == name, F.col("_order")))

    def variant_report(name: str) -> Column:
        part = F.col(f"_{name}")
        return F.struct(
            F.lit(name).alias("variant"),
            F.coalesce(part["patch"], F.lit("")).alias("generated_patch"),
            part["run_skipped"].alias("run_skipped"),
            part["run_result"].alias("run_result"),
            part["outcome"].alias("outcome"),
            *[part[path].alias(path) for path in _known(results, VARIANT_PATHS)],
        )

    def verdict_of(name: str) -> Column:
        base, part = F.col(f"_{BASELINE}")["outcome"], F.col(f"_{name}")
        return verdict(
            base["status"],
            base["failure_count"],
            part["outcome"]["status"],
            part["outcome"]["failure_count"],
            part["run_skipped"],
        )

    ordered = results.withColumn("_order", run_order(results))
    folded = ordered.groupBy(*keys).agg(*[of(name).alias(f"_{name}") for name in (BASELINE, *VARIANTS)])
    base = F.col(f"_{BASELINE}")
    return folded.select(
        *keys,
        base["framework"].alias("framework"),
        utc_iso(created_at).alias("created_at"),
        F.struct(
            base["run_result"].alias("run_result"),
            F.when(base["has_trace"], 1).otherwise(0).alias("trace_count"),
            base["outcome"].alias("outcome"),
            *[base[path].alias(path) for path in _known(results, BASELINE_PATHS)],
        ).alias(BASELINE),
        *[variant_report(name).alias(name) for name in VARIANTS],
        F.create_map(
            F.lit("reference_swebench"),
            F.coalesce(base["patch"], F.lit("")),
            *[
                part
                for name in VARIANTS
                for part in (F.lit(f"llm_{name}"), F.coalesce(F.col(f"_{name}")["patch"], F.lit("")))
            ],
        ).alias("patches"),
        F.create_map(
            *[part for name in VARIANTS for part in (F.lit(f"{name}_verdict"), verdict_of(name))]
        ).alias("comparison"),
    )


def _known(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [name for name in names if name in df.columns]


def init_headers(runs: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Headers of runs that begin, from a row per run: dataset, split, model, paths and number of instances."""
    return runs.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *[F.col(c) for c in ("run_id", "dataset", "split", "model")],
        *_known(runs, ("predictions_path",)),
        utc_iso(created_at).alias("created_at"),
        F.lit(None).cast("string").alias("completed_at"),
        *_known(runs, ("log_path", "total_instances")),
    )


def complete_headers(headers: DataFrame, completed_at: Column | None = None) -> DataFrame:
    """Headers of runs that are done."""
    return headers.withColumn("completed_at", utc_iso(completed_at))


def split_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful and failed runs; a missing flag is a failure."""
    ok = F.coalesce("success", F.lit(False))
    return runs.where(ok), runs.where(~ok)


def error_records(rows: DataFrame, error_type: Column, error_message: Column) -> DataFrame:
    """Failing instances as ``{instance_id, error_type, error_message}`` rows."""
    return rows.where(error_message.isNotNull()).select(
        "instance_id", error_type.alias("error_type"), error_message.alias("error_message")
    )
