"""Classification of test logs, run results and test commands, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import strip

# Test-log patterns. (?d) keeps \n as the only line end, (?U) gives Unicode \b and \s.
FAILED_LINE = r"(?Umd)^FAILED\b"
FAILED_TALLY = r"(?U)\b[0-9]+\s+failed\b"
OK_LINE = r"(?Umd)^OK\b"
COUNTED = r"(?:failures|errors)=([0-9]+)"
FIRST_TALLY = r"(?U)([0-9]+)\s+failed\b"
RAN_TESTS = r"(?U)Ran\s+([0-9]+)\s+tests"
SUMMARY_LINES = (r"(?md)^FAILED.*$", r"(?md)^OK.*$", r"(?md)^=.*(?:failed|passed).*$")

# Test-command markers, and messages of runs without a result.
FRAMEWORK_MARKERS = (
    ("pytest", ("pytest", "py.test")),
    ("django", ("manage.py test", "runtests.py")),
    ("unittest", ("python -m unittest", "unittest")),
)
NO_PATCH_SUMMARY = "not run (no patch extracted)"
RUN_FAILED_SUMMARY = "variant execution failed"
PATCH_APPLY_FAILED = "Patch Apply Failed"


def classify_framework(script: Column) -> Column:
    """Test framework of a command text, or of an array of command lines."""
    text = F.lower(script)
    result = F.lit("unknown")
    for name, markers in reversed(FRAMEWORK_MARKERS):
        hit = text.contains(markers[0])
        for marker in markers[1:]:
            hit = hit | text.contains(marker)
        result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def join_script(lines: Column) -> Column:
    return F.array_join(lines, " ")


def parse_outcome(text: Column) -> Column:
    """``struct(status, failure_count, ran_tests, summary_line)`` of a test log.

    The rules are kept as they are used for the published verdicts: ``0 failed``
    counts as failed, a pytest log with only ``n passed`` is unknown, and
    ``expected failures=n`` adds to the failures.
    """
    text = F.coalesce(text, F.lit(""))
    # A plain substring test is far cheaper than a pattern and spares most of them.
    says_failed, says_ok, tallies = text.contains("FAILED"), text.contains("OK"), text.contains("failed")
    failed = (says_failed & text.rlike(FAILED_LINE)) | (tallies & text.rlike(FAILED_TALLY))
    passed = says_ok & text.rlike(OK_LINE)
    status = F.when(failed, "failed").when(passed, "passed").otherwise("unknown")

    counts = F.transform(F.regexp_extract_all(text, F.lit(COUNTED), F.lit(1)), lambda n: n.try_cast("bigint"))
    # The sum of an empty list is null.
    total = F.aggregate(counts, F.lit(None).cast("bigint"), lambda a, n: F.coalesce(a, F.lit(0)) + n)
    counted = F.when(text.contains("failures=") | text.contains("errors="), total)
    tally = F.when(tallies, _number(text, FIRST_TALLY))
    # greatest skips nulls, so a single known count stands
    failures = F.when(status == "passed", F.lit(0).cast("bigint")).otherwise(F.greatest(counted, tally))

    ran = F.when(text.contains("Ran"), _number(text, RAN_TESTS))
    guards = (says_failed, says_ok, tallies | text.contains("passed"))
    found = [F.when(g, F.nullif(F.regexp_extract(text, p, 0), F.lit(""))) for g, p in zip(guards, SUMMARY_LINES)]
    summary = F.coalesce(*found, F.lit(""))
    return F.struct(
        status.alias("status"),
        failures.alias("failure_count"),
        ran.alias("ran_tests"),
        strip(summary).alias("summary_line"),
    )


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def run_outcome(patch: Column, success: Column, error: Column, output: Column) -> Column:
    """Outcome of a variant run, with ``run_skipped`` when its tests did not run."""
    no_patch = strip(F.coalesce(patch, F.lit(""))) == ""
    run_error = F.coalesce(F.nullif(error, F.lit("")), F.lit(RUN_FAILED_SUMMARY))
    none = F.lit(None).cast("bigint")
    not_run = _outcome("not_run", none, F.lit(NO_PATCH_SUMMARY))
    broken = F.struct(
        F.when(run_error.contains(PATCH_APPLY_FAILED), "apply_failed").otherwise("not_run").alias("status"),
        none.alias("failure_count"),
        none.alias("ran_tests"),
        run_error.alias("summary_line"),
    )
    ran = F.coalesce(success, F.lit(False))
    outcome = F.when(no_patch, not_run).when(~ran, broken).otherwise(parse_outcome(output))
    return outcome.withField("run_skipped", no_patch | ~ran)


def _outcome(status: str, count: Column, summary: Column) -> Column:
    return F.struct(
        F.lit(status).alias("status"),
        count.alias("failure_count"),
        count.alias("ran_tests"),
        summary.alias("summary_line"),
    )


def classify_failure_reason(status: Column, summary: Column, error: Column) -> Column:
    """Why a run did not pass; null for a passed one."""
    text = F.lower(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(error, F.lit(""))))
    not_run = (
        F.when(text.contains("no unified diff"), "no_patch_generated")
        .when(text.contains("unauthorized") | text.contains("401"), "llm_request_failed")
        .otherwise("not_run")
    )
    failed = F.when(text.contains("timed out") | text.contains("timeout"), "test_timeout").otherwise("tests_failed")
    return (
        F.when(status == "passed", F.lit(None).cast("string"))
        .when(status == "apply_failed", "patch_apply_failed")
        .when(status == "not_run", not_run)
        .when(status == "failed", failed)
        .otherwise("unknown")
    )


def verdict(
    baseline_status: Column, baseline_failures: Column, status: Column, failures: Column, skipped: Column
) -> Column:
    """A variant run against its baseline."""
    return (
        F.when(F.coalesce(skipped, F.lit(False)) | status.isin("apply_failed", "not_run"), "not_run")
        .when(~baseline_status.eqNullSafe("passed") & (status == "passed"), "fixed")
        .when(failures < baseline_failures, "improved")
        .when(failures == baseline_failures, "unchanged")
        .when(failures > baseline_failures, "regressed")
        .otherwise("unknown")
    )
