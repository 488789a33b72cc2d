"""Frame operators: projections, filters in order, de-duplication, caps and per-trace statistics.

A frames table holds one row per frame: the trace key, ``kind``, ``pos`` (the
position inside the trace and kind), ``file``, ``line``, ``func`` and, where
captured, the maps ``locals`` and ``meta``. Order is always that of ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.locals import DEFAULT_CUTOFF, locals_count, locals_preview, serialize_locals
from tracelake.functions.paths import basename, is_test_path
from tracelake.functions.predicates import not_conftest, not_frozen, not_site_packages, not_stdlib, testbed_only
from tracelake.operators.late import ADDRESS, FileRows, fetch_rows, first_of, last_of, stored
from tracelake.operators.ordinals import leading_rows, previous_value, sequence_number
from tracelake.operators.skew import salted_join
from tracelake.schemas import FRAME_KINDS, TRACE_KEY
from tracelake.session import work_folder

# A step is a predicate Column or a function from frames to frames.
Step = Column | Callable[[DataFrame], DataFrame]

# The default bounds of the pipelines, and names for missing fields.
EXEC_PATH_LIMIT = 500
STEP_FRAMES_LIMIT = 2000
CONTEXT_FILES = 4
UNKNOWN = "<unknown>"
EVENT_KINDS = {"call": "exec_path", "line": "step_frames", "return": "frames"}

# Positions stay far below this power of two.
BRANCH_BITS = 48


# --- projections -----------------------------------------------------------


def strict_frame(raw: Column, with_locals: bool = True) -> Column:
    """``struct(file, line, func, locals, meta, error)`` of a VARIANT frame.

    File, line and func are required; a quoted number is a line. Without
    locals these are empty, whatever the frame holds there.
    """
    file = F.try_variant_get(raw, "$.file", "string")
    line = F.try_variant_get(raw, "$.line", "int")
    func = F.try_variant_get(raw, "$.func", "string")
    error = F.coalesce(
        F.when(file.isNull(), F.lit("frame without file")),
        F.when(line.isNull() & F.try_variant_get(raw, "$.line", "decimal(38,0)").isNotNull(), F.lit("line of a frame is too large")),
        F.when(line.isNull(), F.lit("frame without line")),
        F.when(func.isNull(), F.lit("frame without func")),
        _map_error(raw, "locals") if with_locals else F.lit(None).cast("string"),
        _map_error(raw, "meta"),
    )
    return F.struct(
        file.alias("file"),
        line.alias("line"),
        func.alias("func"),
        (_map_or_empty(raw, "locals") if with_locals else F.create_map().cast("map<string,string>")).alias("locals"),
        _map_or_empty(raw, "meta").alias("meta"),
        error.alias("error"),
    )


def lenient_frame(raw: Column) -> Column:
    """``struct(file, line, func, locals, meta)`` of a VARIANT, or null if it is no object.

    Missing names become ``<unknown>``; the line is 1 unless it is a JSON integer.
    """
    is_integer = F.schema_of_variant(F.try_variant_get(raw, "$.line", "variant")) == "BIGINT"
    frame = F.struct(
        F.coalesce(F.try_variant_get(raw, "$.file", "string"), F.lit(UNKNOWN)).alias("file"),
        F.when(is_integer, F.coalesce(F.try_variant_get(raw, "$.line", "int"), F.lit(1))).otherwise(1).alias("line"),
        F.coalesce(F.try_variant_get(raw, "$.func", "string"), F.lit(UNKNOWN)).alias("func"),
        _map_or_empty(raw, "locals").alias("locals"),
        _map_or_empty(raw, "meta").alias("meta"),
    )
    return F.when(is_object(raw), frame)


def is_object(raw: Column) -> Column:
    return F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))


def _map_or_empty(raw: Column, field: str) -> Column:
    value = F.try_variant_get(raw, f"$.{field}", "map<string,string>")
    return F.coalesce(value, F.create_map().cast("map<string,string>"))


def _map_error(raw: Column, field: str) -> Column:
    value = F.try_variant_get(raw, f"$.{field}", "variant")
    return F.when(value.isNotNull() & ~is_object(value), F.lit(f"{field} of a frame is no object"))


def explode_frames(
    traces: DataFrame, keys: Sequence[str] = TRACE_KEY, kinds: Sequence[str] = FRAME_KINDS
) -> DataFrame:
    """One row per frame of the given arrays, in one pass over the traces."""

    def tagged(kind: str) -> Column:
        fields = traces.schema[kind].dataType.elementType.names

        def field(frame: Column, name: str, kind_of: str) -> Column:
            return (frame[name] if name in fields else F.lit(None)).cast(kind_of).alias(name)

        return F.transform(
            F.coalesce(F.col(kind), F.array().cast(traces.schema[kind].dataType)),
            lambda frame, pos: F.struct(
                F.lit(kind).alias("kind"),
                pos.cast("bigint").alias("pos"),
                field(frame, "file", "string"),
                field(frame, "line", "int"),
                field(frame, "func", "string"),
                field(frame, "locals", "map<string,string>"),
                field(frame, "meta", "map<string,string>"),
            ),
        )

    rows = F.concat(*[tagged(kind) for kind in kinds])
    return traces.select(*keys, F.inline(rows))


def nest_frames(frames: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Frames as the elements of their arrays: one row per frame with its index in ``ordinal``.

    The rows of a trace and kind in order are its array, for a trace of any length. An empty ``meta`` is left out as
    null. ``pos`` only has to sort the frames; the index has no gaps.
    """
    entry = F.struct(
        "file", "line", "func", "locals", F.when(F.size("meta") > 0, F.col("meta")).alias("meta")
    )
    numbered = sequence_number(frames, [*keys, "kind"], "pos", "ordinal")
    return numbered.select(*keys, "kind", "ordinal", entry.alias("frame"))


def project_exec_path(frames: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Only the columns an execution path needs."""
    return frames.select(*keys, "pos", "file", "func", "line")


def with_locals(frames: DataFrame, locals_: Column) -> DataFrame:
    return frames.withColumn("locals", locals_)


def assemble_traces(events: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Tracer events as frames: calls, lines and returns; other kinds are ignored.

    The sequence number of an event is the position of its frame: it orders the
    frames of a kind as their list would. Needs no state, so it also works on a
    stream. A call carries no locals.
    """
    kind = F.col("kind")
    named = F.when(kind == "call", "exec_path").when(kind == "line", "step_frames").when(kind == "return", "frames")
    columns = [
        *keys,
        named.alias("kind"),
        F.col("seq").cast("bigint").alias("pos"),
        "file",
        "line",
        "func",
    ]
    if ADDRESS in events.columns:
        columns.append(ADDRESS)
    if "locals" in events.columns:
        columns.append(F.when(kind != "call", F.col("locals")).alias("locals"))
    return events.where(kind.isin(*EVENT_KINDS)).select(*columns)


# --- steps -----------------------------------------------------------------


def dedup_frames(
    frames: DataFrame,
    by: Sequence[str] = ("file", "func"),
    keys: Sequence[str] = TRACE_KEY,
    order: str = "pos",
) -> DataFrame:
    """The first frame of each ``by`` value per trace.

    An aggregate, not a window: map tasks already keep one row per value, so a
    trace with millions of repeated frames shuffles only its distinct ones.
    """
    if not by:
        raise ValueError("dedup_frames needs at least one column")
    grouping = [*keys, *by]
    carried = [c for c in frames.columns if c not in (*grouping, order)]
    return (
        frames.groupBy(*grouping)
        .agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in carried])
        .select(*frames.columns)
    )


def cap_frames(
    frames: DataFrame, n: int, keys: Sequence[str] = TRACE_KEY, order: str = "pos"
) -> DataFrame:
    """The first ``n`` frames of each trace, see ``leading_rows``. ``order`` must be a number and unique in a trace."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return leading_rows(frames, keys, order, n)


def frame_pipeline(
    frames: DataFrame, steps: Sequence[Step], cutoff: int | None = DEFAULT_CUTOFF
) -> DataFrame:
    """Apply the steps in order, then serialise the locals of the rows that are left."""
    for step in steps:
        frames = frames.where(step) if isinstance(step, Column) else step(frames)
    if cutoff is not None and "locals" in frames.columns:
        frames = with_locals(frames, serialize_locals(F.col("locals"), cutoff))
    return frames


def traceback_pipeline(
    frames: DataFrame, stdlib_paths: Sequence[str] = (), cutoff: int = DEFAULT_CUTOFF
) -> DataFrame:
    """Project frames of a traceback, locals cut. No shuffle."""
    steps = [not_frozen(), not_site_packages(), not_stdlib(stdlib_paths), not_conftest()]
    return frame_pipeline(frames, steps, cutoff)


def exec_path_pipeline(
    frames: DataFrame, keys: Sequence[str] = TRACE_KEY, limit: int = EXEC_PATH_LIMIT
) -> DataFrame:
    """Functions called in the project, each once, in the order of their first call."""
    steps = [
        testbed_only(),
        not_conftest(),
        lambda df: project_exec_path(df, keys),
        lambda df: dedup_frames(df, ("file", "func"), keys),
        lambda df: cap_frames(df, limit, keys),
    ]
    return frame_pipeline(frames, steps, cutoff=None)


def step_frames_pipeline(
    frames: DataFrame,
    keys: Sequence[str] = TRACE_KEY,
    limit: int = STEP_FRAMES_LIMIT,
    cutoff: int = DEFAULT_CUTOFF,
) -> DataFrame:
    """Executed project lines, each once, in the order of their first run."""
    steps = [
        testbed_only(),
        not_conftest(),
        lambda df: dedup_frames(df, ("file", "func", "line"), keys),
        lambda df: cap_frames(df, limit, keys),
    ]
    return frame_pipeline(frames, steps, cutoff)


def late_step_frames(
    table: FileRows,
    keys: Sequence[str] = TRACE_KEY,
    limit: int = STEP_FRAMES_LIMIT,
    cutoff: int = DEFAULT_CUTOFF,
) -> DataFrame:
    """``step_frames_pipeline`` of frames in files: filters, de-duplication and cap go by numbers and names alone, and only
    the frames that are kept bring their variables."""
    slim = table.rows().select(*keys, "pos", "file", "func", "line", ADDRESS)
    steps = [
        testbed_only(),
        not_conftest(),
        lambda df: dedup_frames(df, ("file", "func", "line"), keys),
        # The cap counts traces first, and should not read the frames again for that.
        lambda df: cap_frames(stored(df, "distinct-frames"), limit, keys),
    ]
    return frame_pipeline(fetch_rows(table, frame_pipeline(slim, steps, cutoff=None)), [], cutoff)


def late_dedup(
    table: FileRows, by: Sequence[str] = ("file", "func"), keys: Sequence[str] = TRACE_KEY, order: str = "pos"
) -> DataFrame:
    """``dedup_frames`` of frames in files."""
    return fetch_rows(table, first_of(table.rows(), [*keys, *by], order))


def apply_trace_pipelines(
    frames: DataFrame,
    keys: Sequence[str] = TRACE_KEY,
    limit: int = EXEC_PATH_LIMIT,
    cutoff: int = DEFAULT_CUTOFF,
    stdlib_paths: Sequence[str] = (),
) -> DataFrame:
    """Filtered traceback and execution path; step frames pass unchanged."""
    kind = F.col("kind")
    traceback = traceback_pipeline(frames.where(kind == "frames"), stdlib_paths, cutoff)
    path = exec_path_pipeline(frames.where(kind == "exec_path"), keys, limit).withColumn("kind", F.lit("exec_path"))
    steps = frames.where(kind == "step_frames")
    return traceback.unionByName(path, allowMissingColumns=True).unionByName(steps)


# --- per-trace operators ---------------------------------------------------


def block_index(frames: DataFrame, keys: Sequence[str] = TRACE_KEY, order: str = "pos") -> DataFrame:
    """Add the 0-based position of each frame among the kept ones of its trace."""
    return sequence_number(frames, keys, order, "block_index")


def error_frame(frames: DataFrame, keys: Sequence[str] = TRACE_KEY, order: str = "pos") -> DataFrame:
    """The last frame of each trace, the one closest to the error."""
    rest = [c for c in frames.columns if c not in (*keys, order)]
    return frames.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def late_error_frame(table: FileRows, keys: Sequence[str] = TRACE_KEY, order: str = "pos") -> DataFrame:
    """``error_frame`` of frames in files."""
    return fetch_rows(table, last_of(table.rows(), keys, order))


def error_location(frames: DataFrame | FileRows, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Where each trace failed: file name, line, function and a look at its variables."""
    last = late_error_frame(frames, keys) if isinstance(frames, FileRows) else error_frame(frames, keys)
    return last.select(
        *keys,
        basename(F.col("file")).alias("file_name"),
        "line",
        "func",
        locals_count(F.col("locals")).alias("locals_count"),
        F.array_join(locals_preview(F.col("locals")), "\n").alias("locals_preview"),
    )


def select_trace(
    traces: DataFrame | FileRows, keys: Sequence[str] = ("run_id", "instance_id"), order: str = "trace_pos"
) -> DataFrame:
    """The first trace of each instance. Traces in files are chosen by their place, and only the chosen ones are read."""
    if isinstance(traces, FileRows):
        return fetch_rows(traces, first_of(traces.rows(), keys, order))
    rest = [c for c in traces.columns if c not in (*keys, order)]
    return traces.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])


def find_trace(
    traces: DataFrame, nodeid: str, keys: Sequence[str] = ("run_id", "instance_id"), order: str = "trace_pos"
) -> DataFrame:
    """The first trace of a test, by its node id."""
    return select_trace(traces.where(F.col("nodeid") == nodeid), keys, order)


def variable_changes(
    frames: DataFrame,
    name: str,
    keys: Sequence[str] = TRACE_KEY,
    order: str = "pos",
    locals_column: str = "locals",
) -> DataFrame:
    """Frames at which a variable differs from the frame before in the same function.

    The first value counts as a change from null; a frame without the variable
    has the value null.
    """
    group = [*keys, "func"]
    values = frames.select(*group, order, "file", "line", F.col(locals_column)[name].alias("new_value"))
    return previous_value(values, group, order, "new_value", "old_value").where(
        ~F.col("new_value").eqNullSafe(F.col("old_value"))
    )


# --- statistics and file choice ---------------------------------------------


def trace_stats(traces: DataFrame, frames_per_trace: Column) -> DataFrame:
    """Failures, failures with frames, frames and their mean per failure; mean is null for no failures."""
    return traces.agg(
        F.count(F.lit(1)).alias("failures"),
        F.count_if(frames_per_trace > 0).alias("failures_with_frames"),
        F.coalesce(F.sum(frames_per_trace), F.lit(0)).alias("total_frames"),
        F.avg(frames_per_trace).alias("avg_frames"),
    )


def exception_histogram(traces: DataFrame, order: str = "trace_pos") -> DataFrame:
    """Count and percent by exception type, most frequent first, ties by first appearance."""
    counts = traces.groupBy(F.coalesce("exc_type", F.lit("Unknown")).alias("exc_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")
    )
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("exc_type", "n", "first_seen", (F.lit(100.0) * F.col("n") / total).alias("pct")).orderBy(
        F.desc("n"), F.asc("first_seen")
    )


def trace_context_frames(frames: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Traceback and execution path as one list, the traceback first.

    ``ord`` sorts the list: the branch in its upper bits, then the position. One
    number, so that aggregates over it stay hash aggregates.
    """
    branch = F.when(F.col("kind") == "frames", 0).otherwise(1).cast("bigint")
    return frames.where(F.col("kind").isin("frames", "exec_path")).select(
        *keys, (F.shiftleft(branch, BRANCH_BITS) + F.col("pos")).alias("ord"), "file", "line"
    )


def file_line_map(frames: DataFrame, keys: Sequence[str] = TRACE_KEY, order: str = "pos") -> DataFrame:
    """Lines of each file in order, one row per line with the first position of its file.

    The long form of a file-to-lines map: files sort by ``file_pos``, lines by
    the order column. It has no arrays that grow with a trace.
    """
    lines = frames.select(*keys, order, "file", "line")
    path = work_folder(frames.sparkSession, "first-uses")
    files_by_first_use(frames, keys, order).select(*keys, "file", "file_pos", "n_lines").write.parquet(path)
    files = frames.sparkSession.read.parquet(path)
    # The same small table tells which files are used by very many frames.
    counts = files.select(*keys, "file", F.col("n_lines").alias("_rows"))
    return salted_join(lines, files.drop("n_lines"), [*keys, "file"], spread=[order], how="inner", counts=counts)


def files_by_first_use(frames: DataFrame, keys: Sequence[str] = TRACE_KEY, order: str = "pos") -> DataFrame:
    """The files of each trace with their first position and first line."""
    return frames.groupBy(*keys, "file").agg(
        F.min(order).alias("file_pos"), F.min_by("line", order).alias("first_line"), F.count(F.lit(1)).alias("n_lines")
    )


def context_files(files: DataFrame, keys: Sequence[str] = TRACE_KEY, max_files: int = CONTEXT_FILES) -> DataFrame:
    """The files to show for a trace: tests first, then by first use, up to ``max_files``."""
    ranked = Window.partitionBy(*keys).orderBy("_other", "file_pos")
    return (
        files.withColumn("_other", ~is_test_path(F.col("file")))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= max_files)
        .drop("_other")
    )


def files_to_read(chosen: DataFrame, files: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """Chosen files, then all files by first use, each once.

    ``read_order`` sorts them: chosen ones by rank, the others by first use.
    """
    first = chosen.select(
        *keys, "file", F.struct(F.lit(0).alias("group"), F.col("rank"), F.col("file_pos")).alias("_at")
    )
    rest = files.select(
        *keys, "file", F.struct(F.lit(1).alias("group"), F.lit(0).alias("rank"), F.col("file_pos")).alias("_at")
    )
    return first.unionByName(rest).groupBy(*keys, "file").agg(F.min("_at").alias("read_order"))


def focus_test(files: DataFrame, chosen: DataFrame, keys: Sequence[str] = TRACE_KEY) -> DataFrame:
    """The test file to show per trace and its focus line.

    The first test path among the chosen files, else among all files of the
    trace. Chosen files are tests first and by first use, so both are the test
    path that is used first.
    """
    wanted = chosen.select(*keys, "file", F.lit(0).alias("group"), "file_pos", "first_line")
    others = files.select(*keys, "file", F.lit(1).alias("group"), "file_pos", "first_line")
    return (
        wanted.unionByName(others)
        .where(is_test_path(F.col("file")))
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(F.col("file").alias("test_file"), F.coalesce("first_line", F.lit(1)).alias("focus_line")),
                F.struct("group", "file_pos"),
            ).alias("_best")
        )
        .select(*keys, "_best.test_file", "_best.focus_line")
    )

