"""Source text operators: context around frames, symbol search, project tree and file ranges.

``files`` tables hold ``path`` and ``content`` and, for many code bases, the
columns that name the code base (``keys``, by default the instance).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.paths import PROJECT_ROOT, normalize_path, relative_to_root, tree_entries
from tracelake.functions.text import numbered_range, source_context, split_lines, strip
from tracelake.operators.skew import salted_join, stored_key_counts, used_keys

INSTANCE = ("instance_id",)
NO_TESTCASE = "<testcase source not available from collected frames>"
GRAM = 3


def split_files(files: DataFrame, keys: Sequence[str] = INSTANCE, path: str = "path") -> DataFrame:
    """Files with their text split once into an array of lines."""
    return files.select(*keys, path, split_lines(F.col("content")).alias("lines"))


def source_lines(files: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """One row per source line, numbered from 1."""
    return files.select(
        *keys, "path", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)


def join_source(
    frames: DataFrame,
    files: DataFrame,
    keys: Sequence[str] = INSTANCE,
    spread: Sequence[str] = ("pos",),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Frames with the ``lines`` of their file, null where the file is not known.

    Only files that a frame points to are moved, each split once before it is
    joined, and a file that very many frames point to is spread over tasks.
    """
    on = [*keys, "file"]
    counts = stored_key_counts(frames, on) if counts is None else counts
    texts = files.withColumnRenamed("path", "file").join(used_keys(counts, on), on, "left_semi")
    right = split_files(texts, keys, "file")
    return salted_join(frames, right, on, spread, "left", counts)


def with_source_context(
    frames: DataFrame,
    files: DataFrame,
    around: int = 8,
    keys: Sequence[str] = INSTANCE,
    line: str = "line",
    spread: Sequence[str] = ("pos",),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Frames with the source lines around them."""
    joined = join_source(frames, files, keys, spread, counts)
    return joined.withColumn("context", source_context(F.col("lines"), F.col(line), around)).drop("lines")


def testcase_source(
    focus: DataFrame, files: DataFrame, around: int = 25, keys: Sequence[str] = INSTANCE
) -> DataFrame:
    """The test of each trace with the source around its focus line.

    ``focus`` holds ``test_file`` (null where a trace has none) and ``focus_line``.
    Very many traces may share one test file, or have none.
    """
    wanted = focus.withColumnRenamed("test_file", "file")
    on = [*keys, "file"]
    spread = [c for c in wanted.columns if c not in on]
    shown = join_source(wanted, files, keys, spread).withColumn(
        "context", source_context(F.col("lines"), F.col("focus_line"), around)
    )
    return shown.drop("lines").withColumn(
        "testcase_source",
        F.when(F.col("file").isNull(), F.lit(NO_TESTCASE)).otherwise(
            F.concat(F.lit("Test file: "), F.col("file"), F.lit("\n"), F.col("context"))
        ),
    ).drop("context")


def project_tree(files: DataFrame, keys: Sequence[str] = INSTANCE, root: str = PROJECT_ROOT) -> DataFrame:
    """All folders (with a closing slash) and ``.py`` files of each project, sorted."""
    inside = files.where(F.col("path").startswith(root + "/"))
    entries = inside.select(*keys, F.explode(tree_entries(relative_to_root(F.col("path"), root))).alias("entry"))
    return entries.distinct().orderBy(*keys, "entry")


def open_ranges(
    requests: DataFrame, files: DataFrame, keys: Sequence[str] = INSTANCE, request_key: str = "request_id"
) -> DataFrame:
    """Line ranges of files as asked for by (path, start_line, end_line) requests.

    Each request gets a status, and its numbered lines or the reason why not.
    """
    raw = strip(F.coalesce(F.col("path").cast("string"), F.lit("")))
    # The place is a column of its own, so that it is worked out once per request.
    placed = requests.select(
        request_key,
        *keys,
        raw.alias("_asked"),
        F.col("start_line").try_cast("int").alias("_start"),
        F.col("end_line").try_cast("int").alias("_end"),
        normalize_path(F.col("path").cast("string")).alias("_place"),
    )
    start, end = F.col("_start"), F.col("_end")
    problem = (
        F.when(F.col("_asked") == "", F.lit("Missing argument: path"))
        .when(start.isNull(), F.lit("start_line must be an integer"))
        .when(start < 1, F.lit("start_line must be >= 1"))
        .when(end.isNull(), F.lit("end_line must be an integer"))
        .when(end < 1, F.lit("end_line must be >= 1"))
        .when(end < start, F.lit("end_line must be >= start_line"))
        .otherwise(F.col("_place.error"))
    )
    checked = placed.select(
        request_key,
        *keys,
        "_asked",
        "_start",
        "_end",
        problem.alias("_problem"),
        F.when(problem.isNull(), F.col("_place.path")).alias("path"),
    )
    on = [*keys, "path"]
    counts = stored_key_counts(checked, on)
    texts = files.join(used_keys(counts, on), on, "left_semi")
    joined = salted_join(checked, split_files(texts, keys), on, [request_key], "left", counts)
    error = F.coalesce(
        F.col("_problem"), F.when(F.col("lines").isNull(), F.concat(F.lit("File not found: "), F.col("_asked")))
    )
    text = F.concat(
        F.col("path"), F.lit("\n"), numbered_range(F.col("lines"), F.col("_start"), F.col("_end"))
    )
    return joined.select(
        request_key,
        *keys,
        F.when(error.isNull(), "ok").otherwise("error").alias("status"),
        F.coalesce(error, text).alias("output"),
    )


def search_symbol(
    files: DataFrame, symbols: Sequence[str], keys: Sequence[str] = INSTANCE, regex: bool = False
) -> DataFrame:
    """Lines of ``.py`` files that hold a symbol, one row per hit.

    For a short list of symbols: it travels with the plan, and the files are
    read once without a shuffle. Use ``search_requests`` for a table of symbols.
    """
    wanted = [s.strip() for s in symbols]
    if not all(wanted):
        raise ValueError("Missing argument: symbol")
    lines = source_lines(files.where(F.col("path").endswith(".py")), keys)
    found = F.array_compact(
        F.array(*[F.when(_holds(F.col("line"), s, regex), F.lit(s)) for s in wanted])
    )
    return lines.select(*keys, "path", "line_no", "line", F.explode(found).alias("symbol")).select(
        "symbol", *keys, "path", "line_no", _hit().alias("hit")
    )


def symbol_hits(files: DataFrame, symbols: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Lines of ``.py`` files that hold a symbol of a table of (keys, symbol); literal search.

    Each symbol is searched once, however often it is listed. It is sought by
    its longest part without a blank, which must lie in one word of a line.
    Every distinct word is matched once, by an equi-join on the first letters of
    that part, and only lines with a matching word are tested in full.
    """
    symbol = strip(F.col("symbol"))
    part = F.aggregate(
        F.split("symbol", " "), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)
    )
    asked = (
        symbols.where(symbol != "")
        .select(*keys, symbol.alias("symbol"))
        .distinct()
        .withColumn("part", part)
        .withColumn("gram", F.substring("part", 1, GRAM))
    )
    lines = source_lines(files.where(F.col("path").endswith(".py")), keys).where(F.col("line") != "")
    words = lines.select(*keys, "path", "line_no", F.explode(F.array_distinct(F.split("line", " "))).alias("word"))
    vocabulary = words.select(*keys, "word").where(F.col("word") != "").distinct()
    # Parts shorter than a gram need the shorter starts as well.
    starts = F.transform(
        F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1)),
        lambda g: F.array(g, *[F.substring(g, 1, n) for n in range(1, GRAM)]),
    )
    grams = vocabulary.select(*keys, "word", F.explode(F.array_distinct(F.flatten(starts))).alias("gram"))
    matches = (
        grams.join(asked, [*keys, "gram"])
        .where(F.col("word").contains(F.col("part")))
        .select(*keys, "symbol", "word")
    )
    candidates = words.join(matches, [*keys, "word"]).select(*keys, "symbol", "path", "line_no").distinct()
    return (
        lines.join(candidates, [*keys, "path", "line_no"])
        .where(F.col("line").contains(F.col("symbol")))
        .select(*keys, "symbol", "path", "line_no", _hit().alias("hit"))
    )


def search_requests(
    files: DataFrame, requests: DataFrame, keys: Sequence[str] = INSTANCE, request_key: str = "request_id"
) -> DataFrame:
    """Hits for a table of (request, keys, symbol), one row per request and hit."""
    asked = requests.select(request_key, *keys, strip(F.col("symbol")).alias("symbol"))
    return salted_join(
        symbol_hits(files, requests, keys), asked, [*keys, "symbol"], ["path", "line_no"], how="inner"
    ).select(request_key, *keys, "symbol", "path", "line_no", "hit")


def search_status(
    requests: DataFrame, hits: DataFrame, keys: Sequence[str] = INSTANCE, request_key: str = "request_id"
) -> DataFrame:
    """Each request with its status and number of hits, from the hits of ``symbol_hits``.

    No hits are ok, a blank symbol is not. Hits are counted per symbol before
    they meet the requests.
    """
    counts = hits.groupBy(*keys, F.col("symbol").alias("_symbol")).agg(F.count(F.lit(1)).alias("hits"))
    asked = requests.select(
        request_key, *keys, "symbol", strip(F.coalesce("symbol", F.lit(""))).alias("_symbol")
    )
    blank = F.col("_symbol") == ""
    return salted_join(asked, counts, [*keys, "_symbol"], [request_key], "left").select(
        request_key,
        *keys,
        "symbol",
        F.when(blank, "error").otherwise("ok").alias("status"),
        F.when(blank, F.lit("Missing argument: symbol")).alias("error"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
    )


def _holds(line: Column, symbol: str, regex: bool) -> Column:
    return line.rlike(symbol) if regex else line.contains(symbol)


def _hit() -> Column:
    return F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), F.col("line"))
