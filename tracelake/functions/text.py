"""Text functions over Columns. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries and blanks of a Unicode text.
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ])"
RARE_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The texts a reader of the rendered output relies on.
SOURCE_UNAVAILABLE = "<source unavailable>"
NO_FAILURE_DETAILS = "<no failure details available>"
FAILURE_MARKERS = ("ERROR:", "FAIL:", "FAILED", "AssertionError", "Traceback")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def unix_lines(text: Column) -> Column:
    """The text with ``\\n`` as its only line break. Most texts have no other and pass as they are."""
    return F.when(text.rlike(RARE_BREAK), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    no_lines = F.array().cast("array<string>")
    # A split at a single plain character needs no regular expression.
    return F.when(text == "", no_lines).otherwise(
        F.split(F.regexp_replace(unix_lines(text), "\n\\z", ""), "\n")
    )


def numbered_range(lines: Column, start: Column | int, end: Column | int) -> Column:
    """Lines start..end (1-based, clamped) as ``n: line``, from an array of lines."""
    first = F.greatest(_int(start), F.lit(1))
    last = F.least(F.greatest(_int(end), first), F.size(lines))
    part = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(
        F.transform(part, lambda line, i: F.concat((first + i).cast("string"), F.lit(": "), line)), "\n"
    )


def source_context(lines: Column, line: Column | int, around: Column | int) -> Column:
    """The lines around ``line`` with an arrow on it, from an array of lines.

    The line is clamped to the file. Slicing an array that was split once per
    file keeps the cost per frame at 2 * around + 1 lines.
    """
    count = F.size(lines)
    focus = F.least(F.greatest(_int(line), F.lit(1)), count)
    first = F.greatest(focus - _int(around), F.lit(1))
    last = F.least(focus + _int(around), count)
    rendered = F.transform(
        F.slice(lines, first, last - first + 1),
        lambda text, i: F.concat(
            (first + i).cast("string"), F.when(first + i == focus, " -> : ").otherwise("    : "), text
        ),
    )
    return F.when(lines.isNull() | (count < 1), F.lit(SOURCE_UNAVAILABLE)).otherwise(
        F.array_join(rendered, "\n")
    )


def excerpt(text: Column, limit: int = 500) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) > limit, F.concat(F.left(body, F.lit(limit)), F.lit("..."))).otherwise(body)


def preview(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def first_non_empty(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def failure_lines(text: Column, limit: int = 8) -> Column:
    """The first lines that carry a failure marker."""

    def marked(line: Column) -> Column:
        hit = line.contains(FAILURE_MARKERS[0])
        for marker in FAILURE_MARKERS[1:]:
            hit = hit | line.contains(marker)
        return hit

    return F.slice(F.filter(split_lines(text), marked), 1, limit)


def failure_summary(nodeid: Column, exc_type: Column, message: Column, test_output: Column, has_trace: Column) -> Column:
    from_trace = F.concat(
        F.lit("1. "),
        F.coalesce(nodeid, F.lit("<unknown test>")),
        F.lit(" -> "),
        F.coalesce(exc_type, F.lit("<unknown exception>")),
        F.lit(": "),
        F.coalesce(message, F.lit("")),
    )
    from_output = F.array_join(failure_lines(F.coalesce(test_output, F.lit(""))), "\n")
    return F.when(has_trace, from_trace).otherwise(
        F.coalesce(F.nullif(from_output, F.lit("")), F.lit(NO_FAILURE_DETAILS))
    )


def exception_text(exc_type: Column, message: Column) -> Column:
    return F.concat(
        F.lit("Type: "),
        strip(F.coalesce(exc_type, F.lit(""))),
        F.lit("\nMessage: "),
        strip(F.coalesce(message, F.lit(""))),
    )


def prompt_sections(sections: Sequence[tuple[str, Column]]) -> Column:
    """Sections as ``<name>``, body, ``</name>``, one blank line apart."""
    if not sections:
        return F.lit("")
    return F.concat_ws(
        "\n\n",
        *[F.concat(F.lit(f"<{name}>\n"), F.coalesce(body, F.lit("")), F.lit(f"\n</{name}>")) for name, body in sections],
    )


def tool_result(name: Column, status: Column, output: Column, max_chars: int | None = None) -> Column:
    body = output if max_chars is None else F.left(output, F.lit(max_chars))
    return F.concat(
        F.lit("<tool_result>\nname="), name, F.lit("\nstatus="), status, F.lit("\noutput:\n"), body, F.lit("\n</tool_result>")
    )


def utc_iso(at: Column | None = None) -> Column:
    """ISO-8601 text of a timestamp, in UTC whatever the session zone."""
    return F.date_format(_utc(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def run_stamp(at: Column | None = None) -> Column:
    return F.date_format(_utc(at), "yyyyMMdd'T'HHmmss'Z'")


def _utc(at: Column | None) -> Column:
    return F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())


def _int(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("int")
