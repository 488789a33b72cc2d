"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import metrics, outcomes
from tracelake.plans import comparison
from tracelake.sources import readers, writers

GOOD = {"nodeid": "t", "exc_type": "E", "message": "m", "frames": [{"file": "a.py", "line": "12", "func": "f", "locals": {"k": "1"}}],
        "exec_path": [], "step_frames": [{"line": "12", "locals": [1]}, 7]}


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    content = {
        "two": json.dumps([GOOD, 7, {"nodeid": "second"}]),
        "cut": '[{"a": ',
        "object": '{"nodeid": "o"}',
        "empty": "[]",
        "bad_frame": json.dumps([GOOD, {"frames": [{"file": "a.py", "func": "f", "line": 1}, {"file": "a.py", "func": "f"}]}]),
        "no_list": json.dumps([{"frames": {"x": 1}}]),
        "long_line": json.dumps([{"frames": [{"file": "a.py", "func": "f", "line": 1 << 40}]}]),
        "odd_locals": json.dumps([{"frames": {}, "exec_path": [{"file": "a.py", "func": "f", "line": 1, "locals": 3}]}]),
        "no_bytes": "",
        "indented": json.dumps([{**GOOD, "nodeid": f"t{n}", "message": "a\n  },\nb"} if n % 3 else n for n in range(30)], indent=2),
        "indented_object": json.dumps({"a": {"b": 1}, "c": {"d": 2}}, indent=2),
        "cut_late": json.dumps([GOOD, GOOD, GOOD], indent=2)[:-9],
    }
    for name, text in content.items():
        (root / name).mkdir()
        (root / name / "auto_debug.json").write_text(text)
    (root / "log_only" / "project" / "pkg").mkdir(parents=True)
    (root / "log_only" / "test_output.txt").write_bytes(b"caf\xff\nOK")
    (root / "log_only" / "project" / "pkg" / "a.py").write_bytes(b"x\xff")
    return str(root)


def test_strict_traces_keep_their_position(spark, base):
    every = readers.sound_traces(readers.read_traces(spark, base))
    indented = every.where("instance_id = 'indented'").orderBy("trace_pos").collect()
    assert [(r.trace_pos, r.nodeid) for r in indented] == [(n, f"t{n}") for n in range(30) if n % 3]
    (call,) = every.where("instance_id = 'odd_locals'").first().exec_path
    assert (call.file, call.locals) == ("a.py", {})
    got = every.where("instance_id not in ('indented', 'odd_locals')").orderBy("instance_id", "trace_pos").collect()
    # One bad frame fails the whole instance, one bad piece the whole file.
    assert {r.instance_id for r in got} == {"two"}
    assert [(r.instance_id, r.trace_pos, r.nodeid) for r in got] == [("two", 0, "t"), ("two", 2, "second")]
    (frame,) = got[0].frames
    assert (frame.file, frame.line, frame.func, frame.locals, frame.meta) == ("a.py", 12, "f", {"k": "1"}, {})
    (step,) = got[0].step_frames
    assert (step.file, step.line, step.locals) == ("<unknown>", 1, {})
    assert got[1].frames == []


def test_errors_name_every_bad_document(spark, base):
    got = {r.instance_id: r.error_message for r in readers.read_trace_errors(spark, base).collect()}
    assert got == {
        "cut": "Invalid JSON in trace file",
        "object": "Invalid trace format: expected list",
        "indented_object": "Invalid trace format: expected list",
        "bad_frame": "frame without line",
        "no_list": "frames of a trace is no list",
        "long_line": "line of a frame is too large",
        "cut_late": "Invalid JSON in trace file",
    }
    instances = spark.createDataFrame([("two",), ("gone",)], "instance_id string")
    absent = readers.read_trace_errors(spark, base, instances).where("error_message like 'Trace file not created%'").collect()
    assert [r.instance_id for r in absent] == ["gone"] and absent[0].error_message.startswith(f"Trace file not created: {base}/gone/auto_debug.json. ")


def test_lenient_traces_give_no_errors(spark, base):
    got = readers.read_traces(spark, base, strict=False).collect()
    found = sorted((r.instance_id, r.trace_pos) for r in got if r.instance_id in ("bad_frame", "two"))
    assert found == [("bad_frame", 0), ("bad_frame", 1), ("two", 0), ("two", 2)]
    bad = next(r for r in got if r.instance_id == "bad_frame" and r.trace_pos == 1)
    assert [f.line for f in bad.frames] == [1, 1]


def test_blocks_of_one_file_make_one_list(spark, tmp_path):
    (tmp_path / "x").mkdir()
    traces = [{"nodeid": f"t{n}", "message": "m" * (n % 50)} for n in range(4000)]
    (tmp_path / "x" / "auto_debug.json").write_text(json.dumps(traces, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = spark.read.option("lineSep", readers.ELEMENT_END).text(f"{tmp_path}/*/auto_debug.json")
        assert lines.rdd.getNumPartitions() > 5
        got = readers.read_traces(spark, str(tmp_path)).orderBy("trace_pos").collect()
        pieces = readers.read_pieces(spark, f"{tmp_path}/*/auto_debug.json")
        numbers = [r.piece for r in pieces.orderBy("piece").collect()]
        assert numbers == list(range(len(numbers))) and len(numbers) >= 4000
        # No task holds much more than the others: nothing deals rows out by file.
        plan = readers.parsed_documents(pieces)
        sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 3 * sum(sizes) / len(sizes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.trace_pos, r.nodeid) for r in got] == [(n, f"t{n}") for n in range(4000)]


def test_lists_and_logs(spark, base):
    names = {r.instance_id for r in readers.list_instances(spark, base).collect()}
    assert {"two", "cut", "object", "empty", "bad_frame", "log_only"} <= names
    instances = spark.createDataFrame([("two",), ("log_only",)], "instance_id string")
    found = {r.instance_id: r.trace_exists for r in readers.trace_exists(spark, base, instances).collect()}
    assert found == {"two": True, "log_only": False}
    logs = {r.instance_id: r.output for r in readers.read_test_outputs(spark, base, instances).collect()}
    assert logs == {"two": "", "log_only": "caf�\nOK"}


def test_source_tree(spark, base):
    tree = readers.read_source_tree(spark, base).where("path like '%.py'").collect()
    assert [(r.instance_id, r.path, r.content) for r in tree] == [("log_only", "/testbed/pkg/a.py", "x�")]
    assert readers.read_source_tree(spark, base).count() == 1


def test_framework_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"_comment": "x", "a": "pytest"}))
    assert [tuple(r) for r in readers.read_framework_cache(spark, str(path)).collect()] == [("a", "pytest")]
    path = tmp_path / "broken.json"
    path.write_text("{")
    assert readers.read_framework_cache(spark, str(path)).count() == 0


def report(instance, status):
    outcome = {"status": status, "failure_count": 0, "ran_tests": 1, "summary_line": "OK"}
    return {"instance_id": instance, "framework": "pytest", "created_at": "now", "baseline": {"outcome": outcome},
            "with_runtime": {"outcome": outcome, "run_result": {"error": "boom"}}, "patches": {"llm": "p"}, "comparison": {}}


def test_reports_become_records(spark, tmp_path):
    for name, status in (("a", "passed"), ("b", "failed")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "comparison_report.json").write_text(json.dumps(report(name, status), indent=2))
    for name, text in (("c", json.dumps(report("c", "passed"))[:-30]), ("d", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "comparison_report.json").write_text(text)
    bad = readers.report_errors(spark, f"{tmp_path}/*/comparison_report.json").collect()
    assert {r.path.split("/")[-2]: r.error_message for r in bad} == {"c": "Invalid JSON in report", "d": "Report without instance"}
    reports = readers.read_reports(spark, f"{tmp_path}/*/comparison_report.json")
    assert reports.count() == 2
    got = {(r.instance_id, r.variant): (r.status, r.failure_reason) for r in outcomes.normalize_records(outcomes.report_results(reports)).collect()}
    assert got[("a", "with_runtime")] == ("passed", None) and got[("b", "with_runtime")] == ("failed", "tests_failed")
    assert got[("a", "without_runtime")] == ("not_run", "not_run") and got[("b", "baseline")] == ("failed", "tests_failed")


def test_run_index(spark, tmp_path):
    record = {"instance_id": "a", "variants": {"with_runtime": {"status": "passed"}, "without_runtime": {"status": "failed", "failure_reason": ""}}}
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"schema_version": 1, "run_id": "r", "dataset": "d", "records": [record]}, indent=1))
    header, records = readers.read_run_index(spark, str(path))
    got = metrics.run_metrics(readers.index_records(records), header).first()
    assert (got.dataset, got.with_runtime.success_count, got.without_runtime.failure_reason_counts) == ("d", 1, {"unknown": 1})


@pytest.mark.parametrize("text", ["[1]", '{"records": 3}', "{"])
def test_bad_run_index_fails(spark, tmp_path, text):
    path = tmp_path / "index.json"
    path.write_text(text)
    header, _ = readers.read_run_index(spark, str(path))
    with pytest.raises(Exception, match="Index"):
        header.collect()


def test_run_index_table_keeps_the_completed_header(spark, tmp_path):
    path = str(tmp_path / "index")
    records = spark.createDataFrame([("r", "a")], "run_id string, instance_id string")
    open_header = spark.createDataFrame([("r", "d", None)], "run_id string, dataset string, completed_at string")
    writers.write_run_index(records, open_header, path)
    # Other runs stay, and the same run is written in place of what it had.
    writers.write_run_index(records.withColumn("run_id", F.lit("s")), open_header.withColumn("run_id", F.lit("s")), path)
    both = records.unionByName(records.withColumn("instance_id", F.lit("b")))
    for _ in range(2):
        writers.write_run_index(both, open_header.withColumn("completed_at", F.lit("t")), path)
    assert spark.read.parquet(f"{path}/records").groupBy("run_id").count().orderBy("run_id").collect() == [("r", 2), ("s", 1)]
    assert [tuple(r) for r in writers.latest_headers(spark.read.parquet(f"{path}/headers")).where("run_id = 'r'").collect()] == [("r", "t", "d")]


def test_tables_are_written(spark, tmp_path):
    df = spark.createDataFrame([("r", "frames", 1), ("r", "exec_path", 2)], "run_id string, kind string, pos int")
    writers.write_frames(df, f"{tmp_path}/frames")
    assert spark.read.parquet(f"{tmp_path}/frames").where("kind = 'frames'").count() == 1
    for write in (writers.write_metrics, writers.write_errors):
        write(df, f"{tmp_path}/{write.__name__}")
        assert spark.read.json(f"{tmp_path}/{write.__name__}").count() == 2
    writers.write_artifacts(df, f"{tmp_path}/artifacts")
    assert spark.read.parquet(f"{tmp_path}/artifacts").count() == 2


def test_dataset_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "p")], "instance_id string, model_patch string")
    df.write.parquet(f"{tmp_path}/t")
    assert readers.read_instances(spark, f"{tmp_path}/t").count() == 1
    (tmp_path / "p.jsonl").write_text('{"instance_id": "a"}\n{"instance_id": "b"}\n')
    assert readers.read_predictions(spark, f"{tmp_path}/p.jsonl").count() == 2
    (tmp_path / "p.json").write_text('[{"instance_id": "a"},\n {"instance_id": "b"}]')
    assert readers.read_predictions(spark, f"{tmp_path}/p.json").count() == 2


def test_ingest_writes_traces_frames_and_errors(spark, base, tmp_path):
    # The second run changes nothing.
    for _ in range(2):
        comparison.ingest_traces(spark, base, str(tmp_path), spark.createDataFrame([("gone",)], "instance_id string"))
    frames = spark.read.parquet(f"{tmp_path}/frames").collect()
    assert sorted((r.instance_id, r.trace_pos, r.kind, r.pos, r.line) for r in frames if r.instance_id == "two") == [
        ("two", 0, "frames", 0, 12),
        ("two", 0, "step_frames", 0, 1),
    ]
    assert not [r for r in frames if r.instance_id == "bad_frame"]
    errors = sorted(r.instance_id for r in spark.read.json(f"{tmp_path}/errors").collect())
    assert errors == sorted(["cut", "object", "indented_object", "bad_frame", "no_list", "long_line", "cut_late", "gone"])


def test_many_files_are_made_listed_and_read_in_few_tasks(spark, tmp_path, monkeypatch):
    texts = [(n, f"text {n}\n\u00e9") for n in range(400)] + [(7, "again"), (None, "no key")]
    rows = spark.createDataFrame(texts, "doc long, text string").where("doc is not null")
    src = tmp_path / "i0" / "project" / "src"
    writers.write_texts_by(rows, "doc", str(src))
    assert sum(1 for f in src.rglob("*") if f.is_file()) == 400
    # The same files as Spark's own writer makes.
    monkeypatch.setattr(writers, "_mounted", lambda *_: None)
    writers.write_texts_by(rows, "doc", str(tmp_path / "i1" / "project" / "src"))
    asked = spark.conf.get(readers.LISTING_TASKS)
    tree = readers.read_source_tree(spark, str(tmp_path))
    assert spark.conf.get(readers.LISTING_TASKS) == asked
    found = {}
    for r in tree.collect():
        found.setdefault(r.instance_id, {})[r.path.split("/")[3]] = sorted(r.content.splitlines())
    want = {f"doc={n}": sorted(t for d, text in texts if d == n for t in text.split("\n")) for n in range(400)}
    assert found == {"i0": want, "i1": want}


def test_no_texts_make_an_empty_tree(spark, tmp_path):
    rows = spark.createDataFrame([], "doc long, text string")
    writers.write_texts_by(rows, "doc", str(tmp_path / "i0" / "project" / "src"))
    assert readers.read_source_tree(spark, str(tmp_path)).count() == 0
