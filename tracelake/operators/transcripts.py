"""Transcript analytics: rendering, tool calls, final patches and session statistics.

A messages table holds ``session_id``, ``turn`` (unique in a session), ``role``,
``content``, ``tool_calls`` (array of id, name, arguments) and ``tool_call_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.diffs import extract_diff
from tracelake.functions.text import rstrip, strip
from tracelake.operators.ordinals import sequence_number
from tracelake.schemas import WITH_RUNTIME

SESSION = ("session_id",)

# The tools of each variant.
PROJECT_TOOLS = ("print_project_tree", "open_file", "search_symbol", "apply_patch")
RUNTIME_TOOLS = (
    "get_test_error",
    "get_execution_trace",
    "get_frames",
    "get_granular_frames",
    "get_variable_change",
)
APPLY_PATCH = "apply_patch"


def message_text(role: Column, content: Column, tool_calls: Column, tool_call_id: Column) -> Column:
    """One message of a transcript, closed by a blank line."""
    calls = F.transform(
        tool_calls,
        lambda c: F.concat(
            F.lit("[tool_call id="),
            F.coalesce(c["id"], F.lit("")),
            F.lit(" name="),
            F.coalesce(c["name"], F.lit("")),
            F.lit("]\n"),
            F.coalesce(c["arguments"], F.lit("")),
        ),
    )
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.concat(F.lit("=== "), F.coalesce(role, F.lit("?")), F.lit(" ==="))),
        F.when(content != "", F.array(content)).otherwise(empty),
        F.coalesce(calls, empty),
        F.when(tool_call_id != "", F.array(F.concat(F.lit("[tool_call_id="), tool_call_id, F.lit("]")))).otherwise(empty),
        F.array(F.lit("")),
    )
    return F.array_join(parts, "\n")


def render_transcripts(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Each session as the parts of one text: (keys, ordinal, text), one part per message.

    The parts in order, put together, are the whole text, whatever its length. Only the last one is stripped at its end.
    """
    text = message_text(F.col("role"), F.col("content"), F.col("tool_calls"), F.col("tool_call_id"))
    numbered = sequence_number(messages, keys, "turn", "ordinal", total="_total")
    last = F.col("ordinal") == F.col("_total") - 1
    part = F.concat(F.when(last, rstrip(text)).otherwise(text), F.lit("\n"))
    return numbered.select(*keys, "ordinal", part.alias("text"))


def parse_tool_calls(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """One row per tool call: name, arguments as a map, and what is wrong with it.

    The arguments must be a JSON object and the name must not be empty.
    """
    calls = messages.select(*keys, "turn", *_variant(messages), F.posexplode("tool_calls").alias("call_no", "c"))
    name = strip(F.coalesce("c.name", F.lit("")))
    raw = F.coalesce(F.nullif(F.col("c.arguments"), F.lit("")), F.lit("{}"))
    return (
        calls.withColumn("_json", F.try_parse_json(raw))
        .withColumn("arguments", _object_map(F.col("_json"), raw))
        .select(
            *keys,
            "turn",
            *_variant(messages),
            "call_no",
            F.nullif(strip(F.coalesce("c.id", F.lit(""))), F.lit("")).alias("tool_call_id"),
            name.alias("name"),
            "arguments",
            F.when(name == "", F.lit("Missing function name"))
            .when(F.col("_json").isNull(), F.lit("Function arguments are not valid JSON"))
            .when(F.col("arguments").isNull(), F.lit("Function arguments must be an object"))
            .alias("error"),
        )
    )


def validate_tool_calls(calls: DataFrame) -> DataFrame:
    """Add ``status``: ok, or error for a malformed call or a tool its variant does not have."""
    known = F.col("name").isin(*PROJECT_TOOLS) | (
        (F.col("variant") == WITH_RUNTIME) & F.col("name").isin(*RUNTIME_TOOLS)
    )
    error = F.coalesce(
        "error",
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unknown tool '"), F.col("name"), F.lit("'"))),
    )
    return calls.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("error")
    )


def join_tool_results(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Tool calls with the content of the message that answers them."""
    calls = parse_tool_calls(messages, keys)
    results = messages.where(F.col("tool_call_id").isNotNull() & (F.col("role") == "tool")).select(
        *keys, "tool_call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result")
    )
    return calls.join(results, [*keys, "tool_call_id"], "left")


def resolve_patches(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """The final patch of each session.

    The first turn that ends it, which is a reply without tool calls that holds
    a diff, or an ``apply_patch`` call with a patch; else the last reply that
    holds a diff; else an empty text.
    """
    reply = F.col("role") == "assistant"
    no_calls = F.coalesce(F.size("tool_calls"), F.lit(0)) < 1
    submitted = F.transform(
        F.filter("tool_calls", lambda c: strip(F.coalesce(c["name"], F.lit(""))) == APPLY_PATCH),
        lambda c: strip(
            F.coalesce(F.try_variant_get(F.try_parse_json(c["arguments"]), "$.patch", "string"), F.lit(""))
        ),
    )
    first = F.get(F.filter(submitted, lambda p: p != ""), F.lit(0))
    found = F.nullif(extract_diff(F.coalesce("content", F.lit(""))), F.lit(""))
    per_turn = messages.select(
        *keys,
        "turn",
        no_calls.alias("_plain"),
        F.when(reply, found).alias("_found"),
        F.when(reply, F.concat(first, F.lit("\n"))).alias("_submitted"),
    )
    final = F.when(F.col("_plain"), F.col("_found")).otherwise(F.col("_submitted"))
    # A null order is skipped, so both pick among the turns that hold a patch.
    chosen = per_turn.withColumn("_final", final).groupBy(*keys).agg(
        F.min_by("_final", F.when(F.col("_final").isNotNull(), F.col("turn"))).alias("_ending"),
        F.max_by("_found", F.when(F.col("_found").isNotNull(), F.col("turn"))).alias("_last"),
    )
    return chosen.select(*keys, F.coalesce("_ending", "_last", F.lit("")).alias("patch"))


def session_stats(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Messages, replies, tool calls and text lengths of each session."""
    reply = F.col("role") == "assistant"
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(reply).alias("turns_used"),
        F.sum(F.when(reply, F.coalesce(F.size("tool_calls"), F.lit(0))).otherwise(0)).alias("tool_calls"),
        F.sum(F.when(reply, F.length(F.coalesce("content", F.lit("")))).otherwise(0)).alias("reply_chars"),
        F.sum(F.when(F.col("role") == "tool", F.length("content")).otherwise(0)).alias("tool_output_chars"),
    )


def tool_stats(messages: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Answers of tools by session, tool and status, with their output length."""
    content = F.col("content")
    answer = content.startswith("<tool_result>\n")
    name = F.regexp_extract(content, r"\A<tool_result>\nname=([^\n]*)\n", 1)
    status = F.regexp_extract(content, r"\A<tool_result>\nname=[^\n]*\nstatus=([^\n]*)\n", 1)
    output = F.regexp_extract(
        content, r"(?s)\A<tool_result>\nname=[^\n]*\nstatus=[^\n]*\noutput:\n(.*)\n</tool_result>\z", 1
    )
    return (
        messages.where(F.col("role") == "tool")
        .select(
            *keys,
            F.when(answer, name).otherwise("").alias("tool"),
            F.when(answer, status).otherwise("error").alias("status"),
            F.length(F.when(answer, output).otherwise(content)).alias("_chars"),
        )
        .groupBy(*keys, "tool", "status")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("_chars").alias("output_chars"))
    )


def _variant(messages: DataFrame) -> list[str]:
    return ["variant"] if "variant" in messages.columns else []


def _object_map(parsed: Column, raw: Column) -> Column:
    """The top-level fields of a JSON object as texts, or null for anything else."""
    return F.when(
        F.schema_of_variant(parsed).startswith("OBJECT"), F.from_json(raw, "map<string,string>")
    )
