"""Rendering of frames, execution paths and prompts as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.locals import locals_text
from tracelake.functions.predicates import in_function
from tracelake.functions.text import exception_text, prompt_sections
from tracelake.operators.frames import EXEC_PATH_LIMIT, block_index, exec_path_pipeline
from tracelake.operators.skew import stored_key_counts
from tracelake.operators.source import INSTANCE, with_source_context
from tracelake.schemas import TRACE_KEY, WITH_RUNTIME, WITHOUT_RUNTIME

EXEC_PATH_HEADER = "## Execution path (functions called during test)"
OMITTED = "intentionally omitted"


def exec_path_text(calls: DataFrame, keys: Sequence[str] = TRACE_KEY, limit: int = EXEC_PATH_LIMIT) -> DataFrame:
    """The execution path of each trace as one text, of at most ``limit`` functions.

    Takes the calls as they were recorded; the bound on a text's length is part of the operator.
    """
    line = F.concat(
        F.lit("  "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" in "), "func", F.lit("()")
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("text"))))
    return exec_path_pipeline(calls, keys, limit).groupBy(*keys).agg(
        F.concat(
            F.lit(EXEC_PATH_HEADER + "\n"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n")
        ).alias("execution_path")
    )


def execution_traces(
    traces: DataFrame, calls: DataFrame, keys: Sequence[str] = TRACE_KEY, limit: int = EXEC_PATH_LIMIT
) -> DataFrame:
    """Every trace with its execution path, empty where it has none."""
    return traces.join(exec_path_text(calls, keys, limit), list(keys), "left").withColumn(
        "execution_path", F.coalesce("execution_path", F.lit(""))
    )


def frame_blocks(
    frames: DataFrame,
    files: DataFrame,
    keys: Sequence[str] = TRACE_KEY,
    around: int = 8,
    file_keys: Sequence[str] = INSTANCE,
) -> DataFrame:
    """One text block per frame: place, source context and locals."""
    counts = stored_key_counts(frames, [*file_keys, "file"])
    shown = with_source_context(block_index(frames, keys), files, around, file_keys, counts=counts)
    text = F.concat(
        F.lit("Block "),
        F.col("block_index").cast("string"),
        F.lit(":\nFile: "),
        F.col("file"),
        F.lit("\nFunction name: "),
        F.col("func"),
        F.lit("\nLine: "),
        F.col("line").cast("string"),
        F.lit("\nContext:\n"),
        F.col("context"),
        F.lit("\nLocals: "),
        locals_text(F.col("locals")),
    )
    return shown.select(*keys, "block_index", text.alias("block"))


def join_blocks(blocks: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Blocks as the parts of one text: (keys, ordinal, text), a blank line apart.

    The texts of a trace in order, put together, are its whole text; no row grows with the trace.
    """
    text = F.when(F.col("block_index") == 0, F.col("block")).otherwise(F.concat(F.lit("\n\n"), "block"))
    return blocks.select(*keys, F.col("block_index").alias("ordinal"), text.alias("text"))


def render_frames(
    frames: DataFrame,
    files: DataFrame,
    keys: Sequence[str] = TRACE_KEY,
    around: int = 8,
    file_keys: Sequence[str] = INSTANCE,
) -> DataFrame:
    """The frames of each trace as the parts of its text."""
    return join_blocks(frame_blocks(frames, files, keys, around, file_keys), keys)


def granular_frames(
    traces: DataFrame,
    step_frames: DataFrame,
    files: DataFrame,
    function: str,
    keys: Sequence[str] = TRACE_KEY,
    around: int = 8,
    file_keys: Sequence[str] = INSTANCE,
) -> DataFrame:
    """The step frames inside one function per trace, as the parts of a text, or a note that there are none."""
    name = function.strip()
    if not name:
        raise ValueError("Missing argument: function_name")
    wanted = step_frames.where(in_function(name)).join(traces.select(*keys).distinct(), list(keys), "left_semi")
    found = render_frames(wanted, files, keys, around, file_keys)
    with_frames = wanted.select(*keys).distinct()
    note = F.lit(f"No step frames found for function: {name}")
    without = traces.select(*keys).join(with_frames, list(keys), "left_anti")
    return found.unionByName(without.withColumns({"ordinal": F.lit(0).cast("bigint"), "text": note}))


def build_prompts(instances: DataFrame, intro: str, instructions: str, runtime_specific: str) -> DataFrame:
    """The prompt of each instance and variant.

    ``instances`` holds ``exc_type``, ``message``, ``failure_summary``,
    ``testcase_source`` and ``execution_path``. The variant without runtime data
    gets the same sections with its runtime parts left out.
    """
    with_runtime = F.col("variant") == WITH_RUNTIME

    def runtime_only(body: Column) -> Column:
        return F.when(with_runtime, body).otherwise(F.lit(OMITTED))

    sections = [
        ("intro", F.lit(intro)),
        ("instructions", F.lit(instructions)),
        ("runtime_specific", runtime_only(F.lit(runtime_specific))),
        ("failure_summary", F.col("failure_summary")),
        ("testcase_source", F.col("testcase_source")),
        ("exception_type", F.coalesce("exc_type", F.lit("TestFailure"))),
        ("exception_body", F.coalesce("message", F.lit("See failure summary"))),
        ("execution_path", runtime_only(F.coalesce("execution_path", F.lit("")))),
    ]
    per_variant = instances.withColumn(
        "variant", F.explode(F.array(F.lit(WITHOUT_RUNTIME), F.lit(WITH_RUNTIME)))
    )
    return per_variant.withColumn("prompt", prompt_sections(sections))


def build_debug_prompts(
    traces: DataFrame, frame_texts: DataFrame, texts: Mapping[str, str], keys: Sequence[str] = TRACE_KEY
) -> DataFrame:
    """The debugging prompt of each trace as the parts of one text: (keys, ordinal, text).

    The first part holds the sections before the frames, then come the parts of ``frame_texts``, and the last part holds
    what follows. A trace without frames has an empty section. ``texts`` gives the fixed sections ``intro``,
    ``instructions`` and ``patch_format``.
    """
    before = prompt_sections(
        [("intro", F.lit(texts["intro"])), ("exception", exception_text(F.col("exc_type"), F.col("message")))]
    )
    after = prompt_sections(
        [("instructions", F.lit(texts["instructions"])), ("patch_format", F.lit(texts["patch_format"]))]
    )
    shown = frame_texts.join(traces.select(*keys).distinct(), list(keys), "left_semi")
    counts = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts"))
    head = traces.select(
        *keys,
        F.lit(0).cast("bigint").alias("ordinal"),
        F.concat(before, F.lit("\n\n<runtime_trace>\n")).alias("text"),
    )
    body = shown.select(*keys, (F.col("ordinal") + 1).alias("ordinal"), "text")
    tail = traces.join(counts, list(keys), "left").select(
        *keys,
        (F.coalesce("_parts", F.lit(0)) + 1).alias("ordinal"),
        F.concat(F.lit("\n</runtime_trace>\n\n"), after).alias("text"),
    )
    return head.unionByName(body).unionByName(tail)
