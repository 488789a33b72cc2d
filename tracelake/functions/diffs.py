"""Unified diffs as Column expressions.

A patch is one value of one row, so finding, parsing and assembling it needs
no shuffle. Texts are cut by zero-width splits, which are linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import strip, unix_lines

# The patterns of a unified diff. (?d) keeps \n as the only line end.
FENCED_BLOCK = r"(?Us)```(?:diff)?\s*\n(.*?)```"
DIFF_START = r"(?s)(?:\A|\n)((?:diff --git |--- ).*)"
FILE_STARTS = r"(?md)(?=^--- )"
PAIRED_FILE_STARTS = r"(?md)(?=^--- [^\n]*\n\+\+\+ )"
BARE_FENCE = r"(?md)^```$"
NEW_FILE_LINE = r"\A--- [^\n]*\n(\+\+\+ [^\n]*)"
ODD_PATH = r"(?:\A|/)\.?(?:/|\z)"
HUNK_FOLLOWS = r"\A[^\n]*\n[^\n]*\n@@"
HUNK_STARTS = r"(?md)(?=^@@)"
HUNK_HEADER = r"(?s)\A@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@.*"


def extract_diff(text: Column) -> Column:
    """The first diff of a text, fenced blocks first; empty when there is none."""
    candidates = F.concat(F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1)), F.array(text))
    bodies = F.transform(candidates, lambda c: strip(F.regexp_extract(c, DIFF_START, 1)))
    first = F.get(F.filter(bodies, lambda b: b != ""), F.lit(0))
    return F.coalesce(F.concat(first, F.lit("\n")), F.lit(""))


def parse_diff(text: Column, strict: bool = False) -> Column:
    """``array(struct(path, hunks, error))``: the file blocks of a text.

    A file starts at a ``--- `` line that a ``+++ `` line must follow; its hunks
    start right after that, and a hunk ends at the next ``@@`` line, ``--- ``
    line or bare fence. With ``strict`` a hunk ends where the lengths of its
    header say, so a deleted line that starts with ``-- `` stays a line and a
    ``diff --git`` line does not join the hunk before it.
    """
    plain = unix_lines(F.coalesce(text, F.lit("")))
    parts = F.split(plain, PAIRED_FILE_STARTS if strict else FILE_STARTS)
    some = F.when(plain.contains("--- "), parts).otherwise(F.array().cast("array<string>"))
    blocks = F.filter(some, lambda b: b.startswith("--- "))
    if not strict:
        blocks = F.transform(blocks, lambda b: F.get(F.split(b, BARE_FENCE, 2), F.lit(0)))
    # Each transform binds what the next one uses, so that it is worked out once.
    named = F.transform(
        blocks, lambda b: F.struct(b.alias("text"), F.regexp_extract(b, NEW_FILE_LINE, 1).alias("new"))
    )
    read = F.transform(
        named,
        lambda b: F.struct(
            b["text"].alias("text"),
            b["new"].alias("new"),
            strip(F.substring(b["new"], 5, 2**30)).alias("path"),
            _hunks(b["text"], strict).alias("hunks"),
        ),
    )
    return F.transform(read, _file)


def diff_error(files: Column) -> Column:
    """The first error of a parsed diff, or null."""
    return F.get(F.filter(F.transform(files, lambda f: f["error"]), lambda e: e.isNotNull()), F.lit(0))


def _hunks(block: Column, strict: bool) -> Column:
    none = F.array().cast("array<string>")
    texts = F.filter(
        F.when(block.rlike(HUNK_FOLLOWS), F.split(block, HUNK_STARTS)).otherwise(none), lambda h: h.startswith("@@")
    )
    cut = F.transform(texts, lambda h: F.split(F.regexp_replace(h, r"\n\z", ""), "\n"))
    # A header that does not match stays as it is, and its first field is no number.
    numbered = F.transform(
        cut,
        lambda lines: F.struct(
            lines.alias("lines"),
            F.split(F.regexp_replace(F.get(lines, F.lit(0)), HUNK_HEADER, "$1,$2,$3,$4"), ",").alias("n"),
        ),
    )
    return F.transform(numbered, lambda h: _hunk(h["lines"], h["n"], strict))


def _hunk(lines: Column, numbers: Column, strict: bool) -> Column:
    def number(i: int) -> Column:
        # Only digits are cast: a cast that fails is costly.
        text = F.get(numbers, F.lit(i))
        return F.when((F.size(numbers) == 4) & (text != ""), text.try_cast("bigint"))

    one = F.lit(1).cast("bigint")
    old_len, new_len = F.coalesce(number(1), one), F.coalesce(number(3), one)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.struct(
        number(0).alias("old_start"),
        old_len.alias("old_len"),
        number(2).alias("new_start"),
        new_len.alias("new_len"),
        (_take_by_lengths(body, old_len, new_len) if strict else body).alias("lines"),
        F.when(number(0).isNull(), F.get(lines, F.lit(0))).alias("bad_header"),
    )


def _file(block: Column) -> Column:
    bad = F.get(F.filter(F.transform(block["hunks"], lambda h: h["bad_header"]), lambda h: h.isNotNull()), F.lit(0))
    old_path = strip(F.regexp_extract(block["text"], r"\A--- ([^\n]*)", 1))
    error = F.when(
        block["new"] == "", F.concat(F.lit("invalid diff: missing +++ after '"), old_path, F.lit("'"))
    ).otherwise(F.concat(F.lit("bad hunk header: '"), bad, F.lit("'")))
    path = block["path"]
    return F.struct(
        F.when(path.rlike(ODD_PATH), _clean_path(path)).otherwise(path).alias("path"),
        F.transform(block["hunks"], lambda h: h.dropFields("bad_header")).alias("hunks"),
        error.alias("error"),
    )


def _take_by_lengths(lines: Column, old_len: Column, new_len: Column) -> Column:
    """The leading lines until both header lengths are used up."""
    sides = F.transform(
        lines,
        lambda line: F.struct(
            F.when(line.startswith("+") | line.startswith("\\"), 0).otherwise(1).alias("old"),
            F.when(line.startswith("-") | line.startswith("\\"), 0).otherwise(1).alias("new"),
        ),
    )
    start = F.struct(F.lit(0).alias("old"), F.lit(0).alias("new"), F.lit(0).alias("taken"))

    def step(acc: Column, side: Column) -> Column:
        more = (acc["old"] < old_len) | (acc["new"] < new_len)
        return F.struct(
            F.when(more, acc["old"] + side["old"]).otherwise(acc["old"]).alias("old"),
            F.when(more, acc["new"] + side["new"]).otherwise(acc["new"]).alias("new"),
            F.when(more, acc["taken"] + 1).otherwise(acc["taken"]).alias("taken"),
        )

    return F.slice(lines, F.lit(1), F.aggregate(sides, start, step)["taken"])


def _clean_path(path: Column) -> Column:
    """A path without empty and ``.`` segments."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    joined = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def assemble_diff(files: Column) -> Column:
    """Git-style diff text of an array of files with hunks.

    Files are one blank line apart. Lines that already carry their leading
    blank and paths that already start with ``b/`` are not prefixed again.
    """

    def hunk_text(hunk: Column) -> Column:
        header = F.format_string(
            "@@ -%d,%d +%d,%d @@", hunk["old_start"], hunk["old_len"], hunk["new_start"], hunk["new_len"]
        )
        body = F.transform(
            hunk["lines"],
            lambda line: F.when(
                line.startswith("+") | line.startswith("-") | line.startswith(" ") | line.startswith("\\"), line
            ).otherwise(F.concat(F.lit(" "), line)),
        )
        return F.array_join(F.concat(F.array(header), body), "\n")

    def file_text(file: Column) -> Column:
        path = F.regexp_replace(file["path"], r"^(?:b/|/)", "")
        head = F.concat(
            F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path
        )
        return F.concat(F.array_join(F.concat(F.array(head), F.transform(file["hunks"], hunk_text)), "\n"), F.lit("\n"))

    return F.array_join(F.transform(files, file_text), "\n")
