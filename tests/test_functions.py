"""Hand-worked cases of the Column functions."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import classify, diffs, locals as local_functions, paths, predicates, text


def evaluate(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_split_lines_equals_python(spark):
    values = ["a\r\nb\n", "", "\n", "a", "a\n\nb", "a b\x85c\x1cd\x1de\x1ef\n\n", "x\ry", "a\x0bb\x0cc", "a b\r\n\r\n"]
    assert evaluate(spark, values, text.split_lines) == [v.splitlines() for v in values]


def test_strip_equals_python(spark):
    values = ["  a b \n", "\x1c\x1d\x85 a ", "　", "", " a　"]
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]
    assert evaluate(spark, values, text.rstrip) == [v.rstrip() for v in values]


def test_source_context_clamps_the_line(spark):
    def shown(line, around):
        return lambda c: text.source_context(text.split_lines(c), F.lit(line), around)

    three = "a\nb\nc"
    assert evaluate(spark, [three, "", None], shown(99, 1)) == [
        "2    : b\n3 -> : c",
        "<source unavailable>",
        "<source unavailable>",
    ]
    assert evaluate(spark, [three], shown(-4, 1)) == ["1 -> : a\n2    : b"]
    assert evaluate(spark, [three], shown(2, 0)) == ["2 -> : b"]


def test_numbered_range_clamps(spark):
    def numbered(start, end):
        return lambda c: text.numbered_range(text.split_lines(c), start, end)

    assert evaluate(spark, ["a\nb\nc", ""], numbered(0, 2)) == ["1: a\n2: b", ""]
    assert evaluate(spark, ["a\nb\nc"], numbered(3, 1)) == ["3: c"]
    assert evaluate(spark, ["a\nb\nc"], numbered(9, 12)) == [""]


def test_excerpt_and_preview(spark):
    assert evaluate(spark, [" " + "x" * 501 + " ", "x" * 500, None], text.excerpt) == ["x" * 500 + "...", "x" * 500, ""]
    assert evaluate(spark, ["y" * 61, "y" * 60], text.preview) == ["y" * 60 + "...", "y" * 60]


def test_failure_summary_prefers_the_trace(spark):
    def summary(has_trace):
        return lambda c: text.failure_summary(F.lit(None), F.lit("KeyError"), F.lit(None), c, F.lit(has_trace))

    assert evaluate(spark, ["x"], summary(True)) == ["1. <unknown test> -> KeyError: "]
    log = "\n".join(["ok", *[f"ERROR: {i}" for i in range(9)], "Traceback"])
    assert evaluate(spark, [log, "fine", None], summary(False)) == [
        "\n".join(f"ERROR: {i}" for i in range(8)),
        "<no failure details available>",
        "<no failure details available>",
    ]


def test_prompt_sections(spark):
    assert evaluate(spark, ["b"], lambda c: text.prompt_sections([("a", c), ("n", F.lit(None))])) == [
        "<a>\nb\n</a>\n\n<n>\n\n</n>"
    ]
    assert evaluate(spark, ["b"], lambda c: text.prompt_sections([])) == [""]


def test_times(spark):
    at = F.timestamp_seconds(F.lit(86399.25))
    assert evaluate(spark, ["x"], lambda c: text.utc_iso(at)) == ["1970-01-01T23:59:59.250000+00:00"]
    assert evaluate(spark, ["x"], lambda c: text.run_stamp(at)) == ["19700101T235959Z"]


def test_json_quote_equals_python(spark):
    values = ['a"b\\c', "é\U0001f600\x7f\x01\n", "plain", "\x0b  \b\f\t", ""]
    assert evaluate(spark, values, local_functions.json_quote) == [json.dumps(v) for v in values]
    kept = evaluate(spark, values, lambda c: local_functions.json_quote(c, ascii_only=False))
    assert kept == [json.dumps(v, ensure_ascii=False) for v in values]


def test_serialized_locals_are_quoted_again_and_cut(spark):
    def serialized(c):
        return local_functions.serialize_locals(F.create_map(F.lit("k"), c), 5)

    assert evaluate(spark, ["abcdef", "é", None], serialized) == [{"k": '"abcd'}, {"k": '"\\u00'}, {"k": "null"}]
    with pytest.raises(ValueError):
        local_functions.serialize_locals(F.lit(None), -1)


def test_locals_text_equals_python(spark):
    def shown(c):
        return local_functions.locals_text(F.create_map(F.lit("a"), c, F.lit("b"), F.lit("é")))

    assert evaluate(spark, ['q"\n'], shown) == [json.dumps({"a": 'q"\n', "b": "é"}, ensure_ascii=False, indent=2)]
    empty = F.create_map().cast("map<string,string>")
    assert evaluate(spark, ["x"], lambda c: local_functions.locals_text(empty)) == ["{}"]


PATHS = {
    "/testbed/a/../b.py": "/testbed/b.py",
    "/testbed": "/testbed",
    "  /testbed/x.py ": "/testbed/x.py",
    "/testbed/a/": "/testbed/a",
    "a/./b//c": "/testbed/a/b/c",
    "/testbed/a..b/.c": "/testbed/a..b/.c",
    "": None,
    "/x/y": None,
    "../../etc": None,
    "//testbed/a": None,
    "/testbed/../etc": None,
    "/testbedx/a": None,
}


def test_normalize_path(spark):
    got = evaluate(spark, list(PATHS), paths.normalize_path)
    assert [r.path for r in got] == list(PATHS.values())
    assert [r.error is None for r in got] == [v is not None for v in PATHS.values()]
    assert got[6].error == "Path cannot be empty"
    assert got[7].error == "Path outside project root: /x/y"


def test_tree_entries(spark):
    assert evaluate(spark, ["a/b/c.py", "x.py", "a/b.txt", ".py"], paths.tree_entries) == [
        ["a/", "a/b/", "a/b/c.py"],
        ["x.py"],
        ["a/"],
        [],
    ]


def test_is_test_path(spark):
    assert evaluate(spark, ["/a/tests/b.py", "test_x.py", "/a/test_x.py", "/a/x_test.py"], paths.is_test_path) == [
        True,
        True,
        True,
        False,
    ]


def test_frame_predicates(spark):
    files = ["/testbed/frozendict.py", "/testbed/a.pyx", "/home/me/lib/python_tools/a.py", "/work/testbed/a.py", "conftest.py", "/testbed/conftest.py", "/opt/x.py"]
    assert evaluate(spark, files, predicates.not_frozen) == [False, True, True, True, True, True, True]
    assert evaluate(spark, files, lambda c: predicates.not_stdlib((), c)) == [True, False, False, True, True, False, True]
    assert evaluate(spark, files, lambda c: predicates.not_stdlib(("/opt/", ""), c))[-1] is False
    assert evaluate(spark, files, lambda c: predicates.testbed_only(file=c)) == [True, True, False, False, False, True, False]
    assert evaluate(spark, files, predicates.not_conftest) == [True, True, True, True, True, False, True]


OUTCOMES = [
    ("Ran 12 tests in 0.1s\n\nOK", ("passed", 0, 12, "OK")),
    ("Ran 9 tests in 0.1s\nFAILED (failures=2, errors=1)", ("failed", 3, 9, "FAILED (failures=2, errors=1)")),
    ("==== 0 failed, 3 passed in 0.2s ====", ("failed", 0, None, "==== 0 failed, 3 passed in 0.2s ====")),
    ("==== 5 passed in 0.2s ====", ("unknown", None, None, "==== 5 passed in 0.2s ====")),
    ("Ran 4 tests in 0.1s\nOK (expected failures=1)", ("passed", 0, 4, "OK (expected failures=1)")),
    ("ERROR: x\nFAILED (errors=2)\n7 failed", ("failed", 7, None, "FAILED (errors=2)")),
    ("Ran 1 test in 0.0s\nOK", ("passed", 0, None, "OK")),
    ("FAILED (failures=1, expected failures=2)", ("failed", 3, None, "FAILED (failures=1, expected failures=2)")),
    ("OKAY\nFAILEDX", ("unknown", None, None, "FAILEDX")),
    ("a OK\r\nOK\r\n", ("passed", 0, None, "OK")),
    ("", ("unknown", None, None, "")),
    (None, ("unknown", None, None, "")),
]


def test_parse_outcome(spark):
    got = evaluate(spark, [t for t, _ in OUTCOMES], classify.parse_outcome)
    assert [tuple(r) for r in got] == [o for _, o in OUTCOMES]


def test_run_outcome(spark):
    def judged(patch, success, error):
        return lambda c: classify.run_outcome(F.lit(patch), F.lit(success), F.lit(error), c)

    assert tuple(evaluate(spark, ["OK"], judged(" \n", True, None))[0]) == (
        "not_run", None, None, "not run (no patch extracted)", True)
    assert tuple(evaluate(spark, ["OK"], judged("p", False, "Patch Apply Failed: x"))[0]) == (
        "apply_failed", None, None, "Patch Apply Failed: x", True)
    assert tuple(evaluate(spark, ["OK"], judged("p", False, ""))[0]) == (
        "not_run", None, None, "variant execution failed", True)
    assert tuple(evaluate(spark, ["OK"], judged("p", True, None))[0]) == ("passed", 0, None, "OK", False)


VERDICTS = [
    (("passed", 0), ("passed", 0), False, "unchanged"),
    (("failed", 3), ("passed", 0), False, "fixed"),
    (("failed", 3), ("failed", 1), False, "improved"),
    (("failed", 1), ("failed", 3), False, "regressed"),
    (("unknown", None), ("failed", 1), False, "unknown"),
    (("unknown", None), ("passed", 0), False, "fixed"),
    (("failed", 1), ("passed", 0), True, "not_run"),
    (("failed", 1), ("apply_failed", None), False, "not_run"),
]


def test_verdict(spark):
    rows = [(i, *b, *v, s) for i, (b, v, s, _) in enumerate(VERDICTS)]
    df = spark.createDataFrame(rows, "i int, bs string, bf long, vs string, vf long, skipped boolean")
    got = df.select("i", classify.verdict(*[F.col(c) for c in ("bs", "bf", "vs", "vf", "skipped")]).alias("v"))
    assert [r.v for r in got.orderBy("i").collect()] == [v for *_, v in VERDICTS]


REASONS = [
    ("passed", "", "", None),
    ("not_run", "No unified diff could be extracted", "", "no_patch_generated"),
    ("not_run", "", "Error code: 401", "llm_request_failed"),
    ("not_run", "", "Unauthorized", "llm_request_failed"),
    ("not_run", "", "timed out after 60s", "not_run"),
    ("failed", "", "Timed out", "test_timeout"),
    ("failed", "x", None, "tests_failed"),
    ("apply_failed", None, None, "patch_apply_failed"),
    ("unknown", None, None, "unknown"),
]


def test_failure_reason(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(REASONS)], "i int, s string, l string, e string")
    got = df.select("i", classify.classify_failure_reason(F.col("s"), F.col("l"), F.col("e")).alias("r"))
    assert [r.r for r in got.orderBy("i").collect()] == [r[3] for r in REASONS]


def test_classify_framework(spark):
    scripts = ["PyTest -rA && ./runtests.py", "python manage.py test", "./runtests.py", "python -m unittest", "bin/test", "py.test"]
    assert evaluate(spark, scripts, classify.classify_framework) == [
        "pytest", "django", "django", "unittest", "unknown", "pytest"]


DIFF = """intro
--- a/x.py
+++ b/x.py
@@ -1 +1,2 @@
-a
+b
 ctx
@@ -9,2 +9 @@ f
 x

--- a/y.py
+++ b//y.py
@@ -3,1 +3,1 @@
-q
+r
```
tail"""


def hunks(files):
    return [(f.path, [(h.old_start, h.old_len, h.new_start, h.new_len, h.lines) for h in f.hunks], f.error) for f in files]


def test_parse_diff(spark):
    got = evaluate(
        spark,
        [DIFF, "--- a\nfoo", "--- a\n+++ b\n@@ bad", "--- a\n+++ b\nz\n@@ -1 +1 @@\n x", "none", "--- a\n```\n+++ b", None, "--- a"],
        diffs.parse_diff,
    )
    assert hunks(got[0]) == [
        ("b/x.py", [(1, 1, 1, 2, ["-a", "+b", " ctx"]), (9, 2, 9, 1, [" x", ""])], None),
        ("b/y.py", [(3, 1, 3, 1, ["-q", "+r"])], None),
    ]
    assert got[1][0].error == "invalid diff: missing +++ after 'a'"
    assert got[2][0].error == "bad hunk header: '@@ bad'"
    assert hunks(got[3]) == [("b", [], None)]
    assert got[4] == [] and got[6] == []
    assert got[5][0].error == "invalid diff: missing +++ after 'a'"
    assert got[7][0].error == "invalid diff: missing +++ after 'a'"


def test_strict_diff_goes_by_the_lengths(spark):
    value = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,1 @@\n--- x\n a\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-q\n+r\ntail"
    (got,) = evaluate(spark, [value], lambda c: diffs.parse_diff(c, strict=True))
    assert hunks(got) == [
        ("b/x.py", [(1, 2, 1, 1, ["--- x", " a"])], None),
        ("b/y", [(1, 1, 1, 1, ["-q", "+r"])], None),
    ]


def test_extract_diff(spark):
    fenced = "x\n```diff\nfoo\n```\n```\n--- a\n+++ b\n```\n--- c"
    assert evaluate(spark, [fenced, "diff --git a ", "a --- b", "", "p\n--- x\ndiff --git y\n", "```diff\nx"], diffs.extract_diff) == [
        "--- a\n+++ b\n",
        "diff --git a\n",
        "",
        "",
        "--- x\ndiff --git y\n",
        "",
    ]


def test_assembled_diff_parses_to_the_same_hunks(spark):
    value = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n ctx\n-a\n+b\n@@ -9 +9 @@\n-p\n+q\n--- a/y.py\n+++ y.py\n@@ -3,1 +3,1 @@\n-q\n+r"
    (once,) = evaluate(spark, [value], diffs.parse_diff)
    (diff,) = evaluate(spark, [value], lambda c: diffs.assemble_diff(diffs.parse_diff(c)))
    (again,) = evaluate(spark, [diff], lambda c: diffs.parse_diff(c, strict=True))
    assert [h for f in once for h in f.hunks] == [h for f in again for h in f.hunks]
    assert diff.startswith("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n") and diff.endswith("\n")


def test_captured_unittest(spark):
    rows = [("error", "tb"), ("failure", "tb"), ("subtest", "tb"), ("subtest", None), ("success", None), (None, "tb")]
    df = spark.createDataFrame(rows, "event string, traceback string")
    assert df.where(predicates.captured_unittest(F.col("event"), F.col("traceback"))).count() == 3
