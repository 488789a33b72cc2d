"""Source, outcome, metric, dataset, patch, transcript and prompt operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake import schemas
from tracelake.operators import dataset, metrics, outcomes, patches, render, source, transcripts

FILES = [
    ("i1", "/testbed/pkg/a.py", "def f():\n    return g.x(1)\n"),
    ("i1", "/testbed/pkg/sub/b.py", "g.x\nab\n"),
    ("i1", "/testbed/doc/a.txt", "g.x\n"),
    ("i2", "/testbed/pkg/a.py", "nothing\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "instance_id string, path string, content string")


def test_project_tree_is_sorted_and_distinct(files):
    got = [tuple(r) for r in source.project_tree(files).collect()]
    assert got == [
        ("i1", "doc/"), ("i1", "pkg/"), ("i1", "pkg/a.py"), ("i1", "pkg/sub/"), ("i1", "pkg/sub/b.py"),
        ("i2", "pkg/"), ("i2", "pkg/a.py")]


def test_search_symbol_is_literal_unless_asked(files):
    got = source.search_symbol(files, ["g.x", "ab"]).collect()
    assert sorted((r.symbol, r.instance_id, r.hit) for r in got) == [
        ("ab", "i1", "/testbed/pkg/sub/b.py:2:ab"),
        ("g.x", "i1", "/testbed/pkg/a.py:2:    return g.x(1)"),
        ("g.x", "i1", "/testbed/pkg/sub/b.py:1:g.x")]
    assert source.search_symbol(files, ["n.th"]).count() == 0
    assert source.search_symbol(files, ["n.th"], regex=True).count() == 1
    with pytest.raises(ValueError):
        source.search_symbol(files, [" "])


def test_search_requests_equals_brute_force(spark, files):
    asked = [(1, "i1", "g.x"), (2, "i1", "g"), (3, "i1", "ab"), (4, "i2", "g.x"), (5, "i1", " "), (6, "i1", "return g.x(1)"), (7, "i2", "n"), (8, "i1", "b")]
    requests = spark.createDataFrame(asked, "request_id int, instance_id string, symbol string")
    want = sorted(
        (q, path, n + 1)
        for q, i, s in asked
        for fi, path, content in FILES
        for n, line in enumerate(content.splitlines())
        if s.strip() and fi == i and path.endswith(".py") and s.strip() in line
    )
    hits = source.search_requests(files, requests)
    assert sorted((r.request_id, r.path, r.line_no) for r in hits.collect()) == want
    status = {r.request_id: (r.status, r.error, r.hits) for r in source.search_status(requests, source.symbol_hits(files, requests)).collect()}
    assert status[5] == ("error", "Missing argument: symbol", 0)
    assert status[4] == ("ok", None, 0) and status[2][2] == len([w for w in want if w[0] == 2])


def test_open_ranges(spark, files):
    asked = [
        (1, "i1", "/testbed/pkg/a.py", "1", "1", "ok", "/testbed/pkg/a.py\n1: def f():"),
        (2, "i1", "pkg/a.py", "2", "9", "ok", "/testbed/pkg/a.py\n2:     return g.x(1)"),
        (3, "i1", " ", "1", "1", "error", "Missing argument: path"),
        (4, "i1", "a.py", "x", "1", "error", "start_line must be an integer"),
        (5, "i1", "a.py", "1", "0", "error", "end_line must be >= 1"),
        (6, "i1", "a.py", "3", "2", "error", "end_line must be >= start_line"),
        (7, "i1", "/etc/passwd", "1", "1", "error", "Path outside project root: /etc/passwd"),
        (8, "i2", "pkg/sub/b.py", "1", "1", "error", "File not found: pkg/sub/b.py"),
    ]
    requests = spark.createDataFrame([a[:5] for a in asked], "request_id int, instance_id string, path string, start_line string, end_line string")
    got = source.open_ranges(requests, files).orderBy("request_id").collect()
    assert [(r.status, r.output) for r in got] == [a[5:] for a in asked]


def test_testcase_source_without_a_test(spark, files):
    focus = spark.createDataFrame([(1, "i1", None, None), (2, "i1", "/testbed/pkg/a.py", 1)], "t int, instance_id string, test_file string, focus_line int")
    got = source.testcase_source(focus, files, 0).orderBy("t").collect()
    assert [r.testcase_source for r in got] == [
        "<testcase source not available from collected frames>",
        "Test file: /testbed/pkg/a.py\n1 -> : def f():"]


def test_rendered_frames_in_parts(spark, files):
    rows = [("t", "i1", p, "/testbed/pkg/a.py", 2, "f", {"k": "é"}) for p in (0, 5, 9)]
    frames = spark.createDataFrame(rows, "trace string, instance_id string, pos long, file string, line int, func string, locals map<string,string>")
    parts = render.render_frames(frames, files, ("trace", "instance_id"), 1).orderBy("ordinal").collect()
    block = "Block {}:\nFile: /testbed/pkg/a.py\nFunction name: f\nLine: 2\nContext:\n1    : def f():\n2 -> :     return g.x(1)\nLocals: {{\n  \"k\": \"é\"\n}}"
    assert [r.ordinal for r in parts] == [0, 1, 2]
    assert "".join(r.text for r in parts) == "\n\n".join(block.format(n) for n in range(3))


def test_debug_prompts_have_one_text_for_every_trace(spark):
    traces = spark.createDataFrame([(1, "E", "m"), (2, None, "n")], "t int, exc_type string, message string")
    parts = spark.createDataFrame([(1, n, f"b{n}") for n in range(600)] + [(3, 0, "x")], "t int, ordinal long, text string")
    texts = {"intro": "I", "instructions": "J", "patch_format": "P"}
    rows = render.build_debug_prompts(traces, parts, texts, ("t",)).orderBy("t", "ordinal").collect()
    whole = {t: "".join(r.text for r in rows if r.t == t) for t in (1, 2)}
    assert [r.ordinal for r in rows if r.t == 1] == list(range(602)) and {r.t for r in rows} == {1, 2}
    text = "<intro>\nI\n</intro>\n\n<exception>\nType: {}\nMessage: {}\n</exception>\n\n<runtime_trace>\n{}\n</runtime_trace>\n\n<instructions>\nJ\n</instructions>\n\n<patch_format>\nP\n</patch_format>"
    assert whole == {1: text.format("E", "m", "".join(f"b{n}" for n in range(600))), 2: text.format("", "n", "")}


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("r", "a", "baseline", "failed", 3, None, "FAILED", False, True, None, "", True),
        ("r", "a", "without_runtime", "passed", 0, 4, "OK", False, True, None, "p1", None),
        ("r", "a", "with_runtime", "not_run", None, None, "not run (no patch extracted)", True, False,
         "No unified diff could be extracted from model response.", "", None),
        ("r", "b", "baseline", "unknown", None, None, "", False, True, None, "", False),
        ("r", "b", "without_runtime", "failed", 1, None, "FAILED", False, True, "Timed out", "p2", None),
        ("r", "b", "with_runtime", "apply_failed", None, None, "Patch Apply Failed", True, False, "Patch Apply Failed", "p3", None),
    ]
    return spark.createDataFrame(
        rows, "run_id string, instance_id string, variant string, status string, failure_count long, ran_tests long, "
        "summary_line string, run_skipped boolean, success boolean, error string, patch string, has_trace boolean"
    ).withColumn("framework", F.lit("pytest"))


def test_verdicts(results):
    got = {(r.instance_id, r.variant): r.verdict for r in outcomes.verdicts(results).collect()}
    assert got == {
        ("a", "without_runtime"): "fixed", ("a", "with_runtime"): "not_run",
        ("b", "without_runtime"): "unknown", ("b", "with_runtime"): "not_run"}


def test_the_latest_delivery_of_a_run_counts(results):
    at = F.when(F.col("status") == "unknown", F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp")
    again = results.where("variant = 'without_runtime'").withColumn("status", F.lit("unknown"))
    twice = results.unionByName(again).withColumn("recorded_at", at)
    early = results.unionByName(again.withColumn("recorded_at", F.lit("2023-01-01").cast("timestamp")), allowMissingColumns=True)
    early = early.withColumn("recorded_at", F.coalesce("recorded_at", F.lit("2024-01-01").cast("timestamp")))
    for df, want in ((twice, "unknown"), (early, "passed")):
        got = {r.variant: r.status for r in outcomes.verdicts(df).where("instance_id = 'a'").collect()}
        assert got["without_runtime"] == want
        assert outcomes.build_records(df).where("instance_id = 'a'").first().variants["without_runtime"].status == want
        assert outcomes.build_reports(df).where("instance_id = 'a'").first().without_runtime.outcome.status == want


def test_headers_begin_and_end(spark):
    runs = spark.createDataFrame([("r", "d", "s", "m", 3)], "run_id string, dataset string, split string, model string, total_instances long")
    header = outcomes.init_headers(runs, F.timestamp_seconds(F.lit(0)))
    assert header.first().asDict() == {
        "schema_version": 1, "run_id": "r", "dataset": "d", "split": "s", "model": "m",
        "created_at": "1970-01-01T00:00:00.000000+00:00", "completed_at": None, "total_instances": 3}
    assert outcomes.complete_headers(header).first().completed_at is not None


def test_report_runs_keep_what_is_known(results):
    known = results.withColumns({"runtime": F.lit(1.5), "traceback": F.lit("tb"), "trace_path": F.lit("/t"), "num_failures": F.lit(2)})
    run = outcomes.build_reports(known).where("instance_id = 'a'").first().with_runtime.run_result
    assert (run.runtime, run.traceback, run.trace_path, run.num_failures) == (1.5, "tb", "/t", 2)
    fields = results.withColumns({"artifact_report_path": F.lit("/r")})
    record = outcomes.build_records(fields).first()
    assert (record.framework, record.artifact_report_path) == ("pytest", "/r")


def test_metrics_scan_the_records_once(results):
    records = outcomes.normalize_records(results).where("variant <> 'baseline'")
    headers = results.select("run_id").distinct()
    plan = metrics.run_metrics(records, headers)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_records_default_a_missing_status(spark):
    rows = [("a", "baseline", None, None, None), ("a", "with_runtime", None, None, " trace ")]
    df = spark.createDataFrame(rows, "instance_id string, variant string, status string, error string, traceback string")
    df = df.withColumn("summary_line", F.lit(None).cast("string"))
    got = {r.variant: r for r in outcomes.normalize_records(df).collect()}
    assert (got["baseline"].status, got["baseline"].failure_reason, got["baseline"].raw_error_excerpt) == ("unknown", "unknown", "")
    assert (got["with_runtime"].status, got["with_runtime"].failure_reason) == ("not_run", "not_run")
    assert got["with_runtime"].raw_error_excerpt == "trace"


def test_reports_carry_patches_and_verdicts(results):
    got = {r.instance_id: r for r in outcomes.build_reports(results).collect()}
    assert got["a"].patches == {"reference_swebench": "", "llm_without_runtime": "p1", "llm_with_runtime": ""}
    assert got["a"].comparison == {"without_runtime_verdict": "fixed", "with_runtime_verdict": "not_run"}
    assert got["a"].baseline.trace_count == 1 and got["b"].baseline.trace_count == 0
    assert got["b"].with_runtime.outcome.status == "apply_failed"


def test_index_record_has_both_variants(results):
    got = outcomes.build_records(results).where("instance_id = 'a'").first()
    assert got.baseline.status == "failed"
    assert {k: v.failure_reason for k, v in got.variants.items()} == {"without_runtime": None, "with_runtime": "no_patch_generated"}


def test_run_result_record_drops_nulls_and_traces(spark):
    df = spark.createDataFrame([("a", True, None)], "instance_id string, success boolean, error string").withColumn("traces", F.array(F.lit("x")))
    assert json.loads(outcomes.run_result_records(df).first().record) == {"instance_id": "a", "success": True}


def test_metrics(spark, results):
    records = outcomes.normalize_records(results).where("variant <> 'baseline'")
    header = spark.createDataFrame([("r", "d", "test", "m"), ("empty", "d", "test", "m")], "run_id string, dataset string, split string, model string")
    got = {r.run_id: r for r in metrics.run_metrics(records, header).collect()}
    without = got["r"].without_runtime
    assert (without.total_instances, without.success_count, without.failure_count) == (2, 1, 1)
    assert (without.success_rate, without.failure_rate) == (0.5, 0.5)
    assert without.status_counts == {"passed": 1, "failed": 1} and without.failure_reason_counts == {"test_timeout": 1}
    assert got["r"].with_runtime.failure_reason_counts == {"no_patch_generated": 1, "patch_apply_failed": 1}
    empty = got["empty"].with_runtime
    assert (empty.total_instances, empty.success_rate, empty.status_counts) == (0, 0.0, {})
    long = {r.variant: r for r in metrics.variant_metrics(records).collect()}
    assert long["without_runtime"].success_rate == 0.5


def test_collection_summary_and_split(spark):
    runs = spark.createDataFrame([("a", "pytest", True, 3), ("b", "pytest", False, 9), ("c", "django", None, None)], "instance_id string, framework string, success boolean, num_failures long")
    got = {r.framework: tuple(r)[1:] for r in metrics.collection_summary(runs).collect()}
    assert got == {"pytest": (2, 1, 1, 3), "django": (1, 0, 1, 0)}
    ok, failed = outcomes.split_runs(runs)
    assert (ok.count(), failed.count()) == (1, 2)


def test_dataset_joins(spark):
    instances = spark.createDataFrame([("django__django-1",), ("sympy__sympy-2",), ("a__b-3",)], "instance_id string")
    predictions = spark.createDataFrame([("a__b-3", 1, "old"), ("a__b-3", 5, "new"), ("django__django-1", 2, None)], "instance_id string, ord int, model_patch string")
    matched = {r.instance_id: r.model_patch for r in dataset.match_predictions(instances, predictions).collect()}
    assert matched == {"a__b-3": "new", "django__django-1": None}
    assert [r.instance_id for r in dataset.missing_predictions(instances, predictions).collect()] == ["sympy__sympy-2"]
    assert dataset.select_instances(instances, ["a__b-3", "x"]).count() == 1
    assert dataset.select_instances(instances, exclude_repos=["django/django", "a/b"]).count() == 1
    assert dataset.select_instances(instances).count() == 3
    repos = spark.createDataFrame([("django/django",)], "repo string")
    assert dataset.exclude_repo_table(instances, repos).count() == 2
    # Both forms test the beginning of an id, wherever its number starts.
    ids = spark.createDataFrame([("psf__requests-1",), ("psf__requests-html-2",), ("psf__black-1",), (None,)], "instance_id string")
    for names in (["psf/requests"], ["psf/req", "x/y"], ["psf/black-1"], ["nobody/none"]):
        table = dataset.exclude_repo_table(ids.dropna(), spark.createDataFrame([(n,) for n in names], "repo string"))
        listed = dataset.select_instances(ids.dropna(), exclude_repos=names)
        assert sorted(table.collect()) == sorted(listed.collect())


def test_framework_cache_wins(spark):
    specs = spark.createDataFrame([("a", ["./x", "PyTest"]), ("b", ["py.test"])], "instance_id string, eval_script array<string>")
    cache = spark.createDataFrame([("b", "django")], "instance_id string, framework string")
    assert {r.instance_id: r.framework for r in dataset.detect_framework(specs, cache).collect()} == {"a": "pytest", "b": "django"}
    assert {r.framework for r in dataset.detect_framework(specs).collect()} == {"pytest"}


def test_patch_rows_and_errors(spark):
    df = spark.createDataFrame([(1, "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y\n z"), (2, "--- a\nb"), (3, "")], "id int, patch string")
    hunks = patches.explode_hunks(df, ["id"])
    assert [(r.id, r.path, r.lines) for r in hunks.collect()] == [(1, "b/f", ["-x", "+y", " z"])]
    assert [r.kind for r in patches.patch_lines(hunks, ["id"]).orderBy("line_no").collect()] == ["deleted", "added", "context"]
    assert [(r.id, r.error) for r in patches.patch_errors(df, ["id"]).collect()] == [(2, "invalid diff: missing +++ after 'a'")]


CALLS = "array<struct<id:string,name:string,arguments:string>>"
MESSAGE = f"session_id string, turn int, role string, content string, tool_calls {CALLS}, tool_call_id string, variant string"


def message(session, turn, role, content, calls=None, answer=None, variant="without_runtime"):
    return (session, turn, role, content, calls, answer, variant)


def test_transcript_text_in_parts(spark):
    rows = [
        message("s", 0, "user", "hi"),
        message("s", 1, "assistant", "", [("c1", "open_file", '{"path": "a"}'), ("c2", "x", None)]),
        message("s", 2, "tool", "out  \n", None, "c1"),
    ]
    df = spark.createDataFrame(rows, MESSAGE)
    whole = '=== user ===\nhi\n\n=== assistant ===\n[tool_call id=c1 name=open_file]\n{"path": "a"}\n[tool_call id=c2 name=x]\n\n\n=== tool ===\nout  \n\n[tool_call_id=c1]\n'
    parts = transcripts.render_transcripts(df).orderBy("ordinal").collect()
    assert [r.ordinal for r in parts] == [0, 1, 2] and "".join(r.text for r in parts) == whole


def test_resolved_patches(spark):
    diff = "```diff\n--- a\n+++ b\n```"
    submit = [("c", "apply_patch", json.dumps({"patch": " --- p\n"}))]
    rows = [
        message("first reply", 0, "assistant", diff), message("first reply", 1, "assistant", "--- late"),
        message("submitted", 0, "assistant", diff, [("c", "open_file", "{}")]), message("submitted", 1, "assistant", "", submit),
        message("last reply", 0, "assistant", "--- one", [("c", "open_file", "{}")]),
        message("last reply", 1, "assistant", "--- two", [("c", "apply_patch", '{"patch": " "}')]),
        message("none", 0, "user", diff),
        message("bad json", 0, "assistant", "", [("c", "apply_patch", "{"), ("d", "apply_patch", '{"patch": "x"}')]),
    ]
    got = {r.session_id: r.patch for r in transcripts.resolve_patches(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert got == {"first reply": "--- a\n+++ b\n", "submitted": "--- p\n", "last reply": "--- two\n", "none": "", "bad json": "x\n"}


def test_tool_calls(spark):
    calls = [("1", "open_file", '{"path": "a"}'), ("2", " ", "{}"), ("3", "get_frames", ""), ("4", "search_symbol", "[1]"), (None, "open_file", "{")]
    rows = [message("s", 1, "assistant", "", calls), message("t", 1, "assistant", "", calls[2:3], variant="with_runtime"),
            message("s", 2, "tool", "<tool_result>\nname=open_file\nstatus=ok\noutput:\nabc\n</tool_result>", None, "1")]
    df = spark.createDataFrame(rows, MESSAGE)
    checked = transcripts.validate_tool_calls(transcripts.parse_tool_calls(df)).orderBy("session_id", "call_no").collect()
    assert [(r.status, r.error) for r in checked] == [
        ("ok", None), ("error", "Missing function name"), ("error", "Unknown tool 'get_frames'"),
        ("error", "Function arguments must be an object"), ("error", "Function arguments are not valid JSON"), ("ok", None)]
    assert checked[0].arguments == {"path": "a"} and checked[2].arguments == {}
    joined = transcripts.join_tool_results(df).where("tool_call_id = '1'").collect()
    assert [r.result_turn for r in joined] == [2]
    assert [tuple(r) for r in transcripts.tool_stats(df).collect()] == [("s", "open_file", "ok", 1, 3)]
    stats = {r.session_id: r for r in transcripts.session_stats(df).collect()}
    assert (stats["s"].turns_used, stats["s"].tool_calls) == (1, 5)


def test_prompts_differ_only_in_runtime_parts(spark):
    df = spark.createDataFrame([("t", None, None, "fs", "ts", None)], "id string, exc_type string, message string, failure_summary string, testcase_source string, execution_path string")
    got = {r.variant: r.prompt for r in render.build_prompts(df, "in", "do", "rt").collect()}
    assert set(got) == set(schemas.VARIANTS)
    assert "<exception_type>\nTestFailure\n</exception_type>" in got["with_runtime"]
    assert "<execution_path>\nintentionally omitted\n</execution_path>" in got["without_runtime"]
    assert "<execution_path>\n\n</execution_path>" in got["with_runtime"] and "<runtime_specific>\nrt\n" in got["with_runtime"]
