"""Search by the word index against a plain loop over all lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import code_search

WORDS = ["def", "return", "load_file(", "self.items[0]", "x=1", "größe", "a+b", "foo.bar", "foobar", "fooo", "(x|y)", "€uro", "tab\there"]


def sources(seed=1):
    rng = random.Random(seed)
    rows = []
    for n in range(12):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice(["i", "j", None]), f"/testbed/f{n}.py" if n % 5 else f"/testbed/f{n}.txt", "\n".join(lines)))
    return rows


LITERAL = ["foo", "foo.bar", "load_file( x=1", "self.items[0]", "größe", "e", "a+b", "(x|y)", " def ", "", "nothing here", "n d", "re"]
REGEX = [
    r"foo.bar", r"foo\.bar", r"fo{2,}", r"foo?bar", r"(load|save)_file\(", r"load_\w+\(", r"return|def", r"^def .*return$", r"x=\d",
    r"[xy]=1", r"self\.items\[\d\]", r"(?i)DEF", r"gr.+e", r"\bfoo\b", r"fo+b?", r"a\+b", r"\(x\|y\)", r"e.o", r"(de)f", r"x\x3d1", r"ret(urn)?", r"tab\there",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files = spark.createDataFrame(sources(), "instance_id string, path string, content string")
    return code_search.build_index(spark, files, str(tmp_path_factory.mktemp("index")))


def by_hand(patterns):
    out = set()
    for instance, path, content in sources():
        for asked, pattern, is_regex in patterns:
            text = pattern.strip()
            if asked != instance or instance is None or not path.endswith(".py") or not text:
                continue
            for n, line in enumerate(content.split("\n"), 1):
                if re.search(text, line) if is_regex else text in line:
                    out.add((instance, text, is_regex, path, n, line))
    return out


def test_patterns(spark, index):
    patterns = [(i, p, False) for p in LITERAL for i in ("i", "j", None)] + [(i, p, True) for p in REGEX for i in ("i", "j")]
    asked = spark.createDataFrame(patterns + patterns[:9], "instance_id string, pattern string, is_regex boolean")
    found = code_search.search_patterns(spark, index, asked).collect()
    got = {(r.instance_id, r.pattern, r.is_regex, r.path, r.line_no, r.line) for r in found}
    assert len(got) == len(found) and got == by_hand(patterns) and len({r[1] for r in got}) > 25
    counts = code_search.pattern_counts(spark, index, asked).collect()
    assert sum(r.hits for r in counts) == len(found)


def test_requests_share_a_search(spark, index):
    rows = [(n, "i", ["foo", r"fo+b", None, " "][n % 4], n % 4 == 1) for n in range(12)]
    asked = spark.createDataFrame(rows, "request_id int, instance_id string, pattern string, is_regex boolean")
    found = code_search.pattern_requests(spark, index, asked).collect()
    want = {p: {x for x in by_hand([("i", p, r)])} for p, r in (("foo", False), (r"fo+b", True))}
    for n in range(12):
        own = {tuple(r)[1:] for r in found if r.request_id == n}
        assert own == (want["foo"] if n % 4 == 0 else want[r"fo+b"] if n % 4 == 1 else set())
    assert code_search.pattern_requests(spark, index, asked.limit(0)).count() == 0


def test_required_parts(spark):
    want = {
        r"load_\w+\(name": ["load_", "(name"], r"fo{2,}bar": ["bar"], r"colou?r": ["colo"], r"abc+def": ["abc", "def"], r"abc|def": [],
        r"(abc)?xyz": ["xyz"], r"(abc|d)xyz": ["xyz"], r"^one two$": ["one", "two"], r"a.b": [], r"(?i)abcd": [], r"[abc]defg*": ["def"],
        r"\x41bcd": [], r"\.items\[": [".items["], r"((((((abc))))))": [], r"abc\sdef": ["abc", "def"],
    }
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    got = {r.p: r.parts for r in rows.select("p", code_search.required_parts(F.col("p"), F.lit(True)).alias("parts")).collect()}
    assert got == want
    literal = rows.select(code_search.required_parts(F.lit("ab cde f(g"), F.lit(False)).alias("parts")).first().parts
    assert literal == ["cde", "f(g"]


def test_basic_patterns_are_those_of_grep(spark, index):
    rows = spark.createDataFrame([("a+b",), (r"fo\+b",), ("(x|y)",), (r"\(foo\)bar",), (r"x=1\|def",)], "p string")
    got = {r.p: r.java for r in rows.select("p", code_search.basic_pattern(F.col("p")).alias("java")).collect()}
    assert got == {"a+b": r"a\+b", r"fo\+b": "fo+b", "(x|y)": r"\(x\|y\)", r"\(foo\)bar": "(foo)bar", r"x=1\|def": "x=1|def"}


def test_without_a_code_base_key(spark, tmp_path):
    files = spark.createDataFrame([("/a.py", "one two\n\nthree"), ("/b.py", "two"), ("/c.py", "")], "path string, content string")
    index = code_search.build_index(spark, files, str(tmp_path / "x"), ())
    asked = spark.createDataFrame([("two", False), ("t", False), ("t.o$", True)], "pattern string, is_regex boolean")
    got = {(r.pattern, r.path, r.line_no) for r in code_search.search_patterns(spark, index, asked).collect()}
    assert got == {("two", "/a.py", 1), ("two", "/b.py", 1), ("t", "/a.py", 1), ("t", "/a.py", 3), ("t", "/b.py", 1), ("t.o$", "/a.py", 1), ("t.o$", "/b.py", 1)}
    empty = code_search.build_index(spark, files.limit(0), str(tmp_path / "y"), ())
    assert code_search.search_patterns(spark, empty, asked).count() == 0


def test_words_are_counted_without_reading_lines(spark, tmp_path):
    files = spark.createDataFrame([("/a.py", "foobar foo\nbar foo\n\nfoo.x xfoo"), ("/b.py", "fo o"), ("/c.txt", "foo")], "path string, content string")
    index = code_search.build_index(spark, files, str(tmp_path / "x"), ())
    asked = spark.createDataFrame([(" foo ",), ("bar",), ("foo",), ("none",), ("",)], "pattern string")
    lines = spark.read.parquet(f"{index.path}/lines")
    empty = spark.createDataFrame([], lines.schema)
    empty.write.mode("overwrite").parquet(f"{index.path}/lines")
    assert {r.pattern: r.hits for r in code_search.pattern_counts(spark, index, asked).collect()} == {"foo": 3, "bar": 2}


def test_expressions_inside_of_words_meet_only_the_lines_they_find(spark, tmp_path):
    lines = ["foobar foo.x", "fooar bar", "foo bar", "xfoobazar", "foozar", "fooooar x"]
    files = spark.createDataFrame([("/a.py", "\n".join(lines))], "path string, content string")
    index = code_search.build_index(spark, files, str(tmp_path / "x"), ())
    asked = spark.createDataFrame([("foo[a-z]?ar", True), ("foo[a-z]?ar", True), ("foo ", False), ("foo.+r", True)], "pattern string, is_regex boolean")
    met = code_search._met(spark, index, code_search._asked(index, asked)).collect()
    assert sorted(r.pattern for r in met) == ["foo"] * 6 + ["foo.+r"] * 6 + ["foo[a-z]?ar"] * 3
    got = {(r.pattern, r.line_no) for r in code_search.search_patterns(spark, index, asked).collect()}
    want = [(p, n) for p in ("foo[a-z]?ar", "foo", "foo.+r") for n, x in enumerate(lines, 1) if re.search(p, x)]
    assert got == set(want)


def test_what_can_only_match_inside_of_a_word(spark):
    inside = [r"abcd[a-z]?[0-9_-]+yz", r"(load|save)_file\(", r"a\.b{2,}c?", "größe", r"self\.items\[0\]", "a\tb"]
    others = [r"a b", r"^abc", r"abc$", r"a.c", r"abc\s", r"abc\b", r"abc[^x]", r"abc[ -z]", r"(?i)abc", r"(?=abc)x", r"\Qa\E", r"abc\1", "a\\ b"]
    rows = spark.createDataFrame([(p,) for p in inside + others], "p string")
    got = [r.p for r in rows.where(code_search._in_word(F.col("p"), F.lit(True))).collect()]
    assert got == inside
    got = [r.p for r in rows.where(code_search._in_word(F.col("p"), F.lit(False))).collect()]
    assert got == [p for p in inside + others if " " not in p]
