"""Functions over the map of local variables of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import preview

DEFAULT_CUTOFF = 1000

# The short escapes of a JSON string.
_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_quote(value: Column, ascii_only: bool = True) -> Column:
    """A text as a JSON string. With ``ascii_only`` all else becomes ``\\uXXXX``."""
    return _close(_short_escapes(value), ascii_only)


def _short_escapes(value: Column) -> Column:
    for raw, escaped in _SHORT_ESCAPES:
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def _close(body: Column, ascii_only: bool) -> Column:
    rare = r"[^ -~]" if ascii_only else r"[\x00-\x1f]"

    def encode(char: Column) -> Column:
        point = F.ascii(char)
        high = F.shiftright(point - 0x10000, 10) + 0xD800
        low = (point - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return (
            F.when(~char.rlike(rare), char)
            .when(point < 0x10000, _escape(point))
            .otherwise(F.concat(_escape(high), _escape(low)))
        )

    # Only a text with such a character pays for the walk over its characters.
    encoded = F.array_join(F.transform(F.regexp_extract_all(body, F.lit("(?s)."), F.lit(0)), encode), "")
    return F.concat(F.lit('"'), F.when(body.rlike(rare), encoded).otherwise(body), F.lit('"'))


def _escape(point: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(point), 4, "0")))


def serialize_locals(values: Column, cutoff: int = DEFAULT_CUTOFF) -> Column:
    """Each value JSON-encoded and cut to ``cutoff`` characters; no map gives an empty one."""
    if cutoff < 0:
        raise ValueError("cutoff must be >= 0")
    # A character never gets shorter, so what is beyond the cutoff in the value is
    # beyond it in the result too, and need not be encoded.
    escaped = F.transform_values(values, lambda _, v: _short_escapes(F.left(v, F.lit(cutoff))))
    cut = F.transform_values(
        escaped, lambda _, v: F.left(F.coalesce(_close(v, ascii_only=True), F.lit("null")), F.lit(cutoff))
    )
    return F.coalesce(cut, F.create_map().cast("map<string,string>"))


def locals_text(values: Column) -> Column:
    """The map as JSON indented by two, keys in their order, non-ASCII kept."""
    body = F.array_join(
        F.transform(
            F.map_entries(values),
            lambda e: F.concat(
                F.lit("  "),
                json_quote(e["key"], ascii_only=False),
                F.lit(": "),
                F.coalesce(json_quote(e["value"], ascii_only=False), F.lit("null")),
            ),
        ),
        ",\n",
    )
    return F.when(values.isNull() | (F.size(values) < 1), F.lit("{}")).otherwise(
        F.concat(F.lit("{\n"), body, F.lit("\n}"))
    )


def locals_count(values: Column) -> Column:
    return F.when(values.isNull(), F.lit(0)).otherwise(F.size(values))


def locals_preview(values: Column, limit: int = 3, width: int = 60) -> Column:
    """The first variables as ``name: value``, long values cut."""
    entries = F.slice(F.map_entries(values), 1, limit)
    return F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), preview(e["value"], width)))
