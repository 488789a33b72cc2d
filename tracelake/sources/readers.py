"""Readers. Bad files become rows of an errors table; they never stop a job.

``instance_id`` comes from the folder of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake import schemas
from tracelake.operators.frames import is_object, lenient_frame, strict_frame
from tracelake.operators.ordinals import sequence_number
from tracelake.session import work_folder
from tracelake.sources import large_json

# File names of the artifact layout, and the folder of a project snapshot.
TRACE_FILE, TEST_OUTPUT_FILE = "auto_debug.json", "test_output.txt"
PROJECT_FOLDER = "project"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
TASK_BYTES = 128 << 20
# Trace files are written with two blanks per level, so this text ends each element of their list but the last: line
# breaks inside of strings are escaped.
ELEMENT_END = "\n  },\n"
NO_INDEX = "Index file must contain JSON"
NO_LIST = "Invalid trace format: expected list"
NO_TRACE_FILE = "Tests may not have failed, or trace collection did not activate."


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, instance_id, length, value)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("instance_id"),
        "length",
        F.col("content").cast("string").alias("value"),
    )


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Trace files in pieces of whole elements: (path, instance_id, piece, pieces, value).

    A file that is written with line breaks comes in one piece per element, and is read in as many tasks as it has
    blocks. Any other file is one piece. Pieces count from 0 in the order of the file.
    """
    lines = spark.read.option("lineSep", ELEMENT_END).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    # The lines of a block are read in order by one task, so their numbers follow on from the first.
    blocks = lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "path",
        "_block",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("path")).alias("pieces"),
    )
    return lines.join(starts, ["path", "_block"]).select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("instance_id"),
        (F.col("_before") + F.col("_id") - F.col("_first")).alias("piece"),
        "pieces",
        "value",
    )


def _parsed(value: Column) -> Column:
    """The document as VARIANT, null if it is not JSON in UTF-8."""
    return F.when(F.is_valid_utf8(value), F.try_parse_json(value))


def document_problem(value: Column, parsed: Column) -> Column:
    """Why a trace document cannot be read, or null."""
    return (
        F.when(value.isNull(), F.lit("Invalid JSON in trace file"))
        .when(~F.is_valid_utf8(value), F.lit("Invalid JSON in trace file: not UTF-8"))
        .when(parsed.isNull(), F.lit("Invalid JSON in trace file"))
        .when(~F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(NO_LIST))
    )


def _piece_text(value: Column) -> Column:
    """A piece as a JSON list of its elements. The only piece of a file is the file.

    The first piece of a file that is no list stays as it is: an object, cut at its fields.
    """
    first, last = F.col("piece") == 0, F.col("piece") == F.col("pieces") - 1
    opened = F.when(first & ~last, F.regexp_replace(value, r"\A\s*\[", "")).otherwise(value)
    # The separator took the end of the element with it.
    closed = F.when(last, F.regexp_replace(opened, r"\]\s*\z", "")).otherwise(F.concat(opened, F.lit("\n  }")))
    whole = (F.col("pieces") == 1) | (first & value.rlike(r"\A\s*\{"))
    return F.when(whole, value).otherwise(F.concat(F.lit("["), closed, F.lit("]")))


def parsed_documents(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Documents or pieces with ``_problem``, why one cannot be read, and ``_traces``, its elements typed. In one parse.

    An element that is no object is there with a false ``is_trace``. Typed frames of the strict form carry their ``error``.
    """
    problem = document_problem
    if "pieces" in documents.columns:
        cut_object = (F.col("pieces") > 1) & (F.col("piece") == 0) & F.col("value").rlike(r"\A\s*\{")
        documents = documents.withColumn("_cut", cut_object).withColumn("value", _piece_text(F.col("value")))

        def problem(value: Column, parsed: Column) -> Column:
            return F.when(F.col("_cut"), F.lit(NO_LIST)).otherwise(document_problem(value, parsed))

    value = F.col("value") if strict else F.make_valid_utf8(F.col("value"))
    rest = [c for c in documents.columns if c not in ("value", "_cut")]
    kept = [c for c in documents.columns if c != "value"]
    read = documents.select(*kept, value.alias("_value"), _parsed(value).alias("_v"))
    traces = F.transform(F.try_variant_get("_v", "$", "array<variant>"), lambda t: _typed_trace(t, strict))
    row = F.struct(problem(F.col("_value"), F.col("_v")).alias("_problem"), traces.alias("_traces"))
    # As a generated row it is worked out once, and filters on it stay behind.
    return read.select(*rest, F.inline(F.array(row)))


def _typed_trace(t: Column, strict: bool) -> Column:
    def frames_of(kind: str) -> Column:
        raw = F.try_variant_get(t, f"$.{kind}", "array<variant>")
        # Only the two arrays that are filtered later must hold well-formed frames. Calls are taken without their locals.
        if strict and kind != "step_frames":
            return F.transform(raw, (lambda f: strict_frame(f)) if kind == "frames" else (lambda f: _call_frame(f)))
        return F.array_compact(F.transform(raw, lambda f: lenient_frame(f)))

    return F.struct(
        is_object(t).alias("is_trace"),
        *[F.try_variant_get(t, f"$.{c}", "string").alias(c) for c in ("nodeid", "exc_type", "message")],
        *[frames_of(kind).alias(kind) for kind in schemas.FRAME_KINDS],
        *([_no_list(t, c).alias(f"no_list_{c}") for c in ("frames", "exec_path")] if strict else []),
    )


def _trace_error(t: Column) -> Column:
    """The first error of a typed trace, or null."""
    of_frames = F.concat(*[F.coalesce(t[k]["error"], F.array().cast("array<string>")) for k in ("frames", "exec_path")])
    first = F.get(F.array_compact(of_frames), F.lit(0))
    return F.when(t["is_trace"], F.coalesce(t["no_list_frames"], t["no_list_exec_path"], first))


def _trace_columns(t: Column, strict: bool) -> list[Column]:
    """The columns of a trace from its typed form."""

    def frames_of(kind: str) -> Column:
        with_error = strict and kind != "step_frames"
        plain = F.transform(t[kind], lambda f: f.dropFields("error")) if with_error else t[kind]
        return F.coalesce(plain, _no_frames()).alias(kind)

    named = [t[c].alias(c) for c in ("nodeid", "exc_type", "message")]
    return [*named, *[frames_of(kind) for kind in schemas.FRAME_KINDS], *([_trace_error(t).alias("error")] if strict else [])]


def parse_traces(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Trace documents as one row per trace, with its position in the document.

    Elements that are no objects are left out but keep their position. The
    three frame arrays come typed; in the strict form a bad frame sets ``error``
    on its trace, in the lenient form it gets defaults or, if it is no object,
    is left out. Documents that cannot be read give no rows, see ``trace_errors``.
    """
    return _exploded(parsed_documents(documents, strict).where("_problem is null"), strict)


def sound_documents(documents: DataFrame) -> DataFrame:
    """The strict traces of documents without an error: one bad frame fails the whole document. In one parse."""
    parsed = parsed_documents(documents).where("_problem is null")
    return _exploded(parsed.where(~F.exists("_traces", lambda t: _trace_error(t).isNotNull())), True)


def _exploded(parsed: DataFrame, strict: bool) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("_problem", "_traces")]
    rows = parsed.select(*rest, F.posexplode("_traces").alias("trace_pos", "_t")).where("_t.is_trace")
    return rows.select(*rest, "trace_pos", *_trace_columns(F.col("_t"), strict))


def store_traces(spark: SparkSession, pieces: DataFrame, path: str, strict: bool = True) -> None:
    """The traces of files in pieces, parsed once and written below ``path``, with what numbers them.

    ``parsed`` has a row per element and per piece without elements, with its piece and its place there; ``pieces`` how
    many elements come before each piece of its file. So positions follow from a running sum over one small row per
    piece, and no task has to see a whole file. ``stored_traces`` reads both.
    """
    parsed = parsed_documents(pieces, strict)
    rest = [c for c in pieces.columns if c != "value"]
    rows = parsed.select(
        *rest,
        "_problem",
        F.coalesce(F.size("_traces"), F.lit(0)).alias("_elements"),
        F.posexplode_outer("_traces").alias("_place", "_t"),
    )
    typed = rows.select(*rest, "_problem", "_elements", "_place", F.col("_t.is_trace").alias("_is_trace"), *_trace_columns(F.col("_t"), strict))
    typed.write.mode("overwrite").parquet(f"{path}/parsed")
    small = spark.read.parquet(f"{path}/parsed").where(F.coalesce("_place", F.lit(0)) == 0)
    counted = small.select("path", "piece", "_elements")
    numbered = sequence_number(counted, ["path"], "piece", "_n", sums={"_before": F.greatest("_elements", F.lit(0))})
    numbered.where("_before > 0").select("path", "piece", "_before").write.mode("overwrite").parquet(f"{path}/pieces")


def stored_traces(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_traces`` wrote: one row per trace, and one per piece that cannot be read, with its ``_problem``.

    In the strict form a problem is also the ``error``, and ``piece`` tells where in the file.
    """
    parsed = spark.read.parquet(f"{path}/parsed").where("_is_trace or _problem is not null")
    # Only pieces behind the first have a row there.
    starts = spark.read.parquet(f"{path}/pieces")
    rows = parsed.join(starts, ["path", "piece"], "left").withColumn(
        "trace_pos", (F.coalesce("_before", F.lit(0)) + F.col("_place")).cast("int")
    )
    if "error" in rows.columns:
        rows = rows.withColumn("error", F.coalesce("_problem", "error"))
    kept = [c for c in parsed.columns if not c.startswith("_") and c not in ("path", "pieces")]
    return rows.select(*kept, "trace_pos", "_problem")


def _no_list(trace: Column, field: str) -> Column:
    """Why the frames of a trace cannot be gone through, or null. Nothing, zero and empty values count as no frames."""
    value = F.try_variant_get(trace, f"$.{field}", "variant")
    empty = F.to_json(value).isin("null", "false", "0", "0.0", '""', "{}")
    return F.when(
        value.isNotNull() & ~F.schema_of_variant(value).startswith("ARRAY") & ~empty,
        F.lit(f"{field} of a trace is no list"),
    )


def sound_traces(traces: DataFrame, key: str = "instance_id") -> DataFrame:
    """The traces of documents without an error: one bad frame fails the whole instance."""
    bad = traces.where("error is not null").select(key).distinct()
    return traces.where("error is null").join(bad, key, "left_anti").select(*traces.columns)


def _call_frame(raw: Column) -> Column:
    return strict_frame(raw, with_locals=False)


def _no_frames() -> Column:
    return F.array().cast(T.ArrayType(schemas.FRAME))


def trace_errors(documents: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row per document that cannot be read, or has a trace with a bad frame."""
    first = F.get(F.array_compact(F.transform("_traces", lambda t: _trace_error(t))), F.lit(0))
    found = parsed_documents(documents.select(key, "value")).select(key, F.coalesce("_problem", first).alias("error"))
    bad = found.where("error is not null")
    return bad.select(key, F.lit("TraceCollectionError").alias("error_type"), F.col("error").alias("error_message"))


def errors_of(traces: DataFrame, key: str = "instance_id") -> DataFrame:
    """The first error of each document, from traces with their errors."""
    place = F.struct(F.coalesce("trace_pos", F.lit(-1)), *(["piece"] if "piece" in traces.columns else []))
    return (
        traces.where("error is not null")
        .groupBy(key)
        .agg(F.min_by("error", place).alias("error_message"))
        .select(key, F.lit("TraceCollectionError").alias("error_type"), "error_message")
    )


def read_traces(spark: SparkSession, base: str, strict: bool = True) -> DataFrame:
    """Traces of all instances below ``base``, one trace file of any size per instance folder.

    Files are parsed at once, into the work folder. In the strict form a file that cannot be read in one place gives no
    traces.
    """
    path = work_folder(spark, "traces")
    store_traces(spark, read_pieces(spark, f"{base}/*/{TRACE_FILE}"), path, strict)
    traces = stored_traces(spark, path)
    sound = traces.where("_problem is null").drop("_problem", "piece")
    if not strict:
        return sound
    broken = traces.where("_problem is not null").select("instance_id").distinct()
    return sound.join(broken, "instance_id", "left_anti").select(*sound.columns)


def read_trace_errors(spark: SparkSession, base: str, instances: DataFrame | None = None) -> DataFrame:
    """Instances whose trace file cannot be used; with ``instances``, also those that have none.

    Spark does not list files without a byte, so these count as none.
    """
    path = work_folder(spark, "traces")
    store_traces(spark, read_pieces(spark, f"{base}/*/{TRACE_FILE}"), path)
    errors = errors_of(stored_traces(spark, path))
    return errors if instances is None else errors.unionByName(absent_files(spark, base, instances))


def absent_files(spark: SparkSession, base: str, instances: DataFrame) -> DataFrame:
    """Errors of instances without a trace file."""
    path = F.concat(F.lit(base.rstrip("/") + "/"), F.col("instance_id"), F.lit(f"/{TRACE_FILE}"))
    message = F.concat(F.lit("Trace file not created: "), path, F.lit(f". {NO_TRACE_FILE}"))
    absent = trace_exists(spark, base, instances.select("instance_id").distinct()).where("not trace_exists")
    return absent.select(
        "instance_id", F.lit("TraceCollectionError").alias("error_type"), message.alias("error_message")
    )


def _instance(folder: Column) -> Column:
    """The instance of a folder, also of one that Spark wrote for a value of ``instance_id``."""
    return F.regexp_replace(folder, r"\Ainstance_id=", "")


def list_instances(spark: SparkSession, base: str) -> DataFrame:
    """Instances with a folder that holds a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    inside = F.substring_index(F.col("path"), base.rstrip("/") + "/", -1)
    return files.select(_instance(F.split(inside, "/")[0]).alias("instance_id"), inside.contains("/").alias("_in")).where(
        "_in"
    ).select("instance_id").distinct()


def trace_exists(spark: SparkSession, base: str, instances: DataFrame, name: str = TRACE_FILE) -> DataFrame:
    """Instances with a flag telling whether their trace file is there. ``name`` may be a pattern of several parts."""
    files = spark.read.format("binaryFile").load(f"{base}/*/{name}")
    folder = _instance(F.element_at(F.split("path", "/"), -2))
    found = files.select(folder.alias("instance_id"), F.lit(True).alias("_found")).distinct()
    return instances.join(found, "instance_id", "left").select(
        *instances.columns, F.coalesce("_found", F.lit(False)).alias("trace_exists")
    )


def read_test_outputs(spark: SparkSession, base: str, instances: DataFrame, name: str = TEST_OUTPUT_FILE) -> DataFrame:
    """The test log of each instance; empty if missing, bad bytes replaced."""
    files = spark.read.format("binaryFile").load(f"{base}/*/{name}")
    folder = _instance(F.element_at(F.split("path", "/"), -2))
    logs = files.select(folder.alias("instance_id"), _text(F.col("content")).alias("_output"))
    return instances.join(logs, "instance_id", "left").select(
        *instances.columns, F.coalesce("_output", F.lit("")).alias("output")
    )


@contextmanager
def _listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in a few tasks per core, not in one for each folder: a task takes longer than many listings."""
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LISTING_TASKS)
        else:
            spark.conf.set(LISTING_TASKS, before)


def read_source_tree(spark: SparkSession, base: str, root: str = "/testbed") -> DataFrame:
    """The project snapshot of each instance folder as (instance_id, path, content).

    Paths are put below ``root``: the file at ``<base>/<instance>/project/a/b.py`` becomes ``<root>/a/b.py``. Other
    artifacts of the folder are no part of the project.
    """
    with _listed_in_few_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    # Spark reads at most 32 small files in a task, which takes longer to start. Tasks read as many bytes as ever.
    n_bytes = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES)))
    inside = F.substring_index(F.col("path"), base.rstrip("/") + "/", -1)
    parts = F.split(inside, "/")
    return files.where(F.get(parts, F.lit(1)) == PROJECT_FOLDER).select(
        _instance(parts[0]).alias("instance_id"),
        F.concat_ws("/", F.lit(root), F.array_join(F.slice(parts, 3, F.size(parts)), "/")).alias("path"),
        _text(F.col("content")).alias("content"),
    )


def _reports(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    corrupt = T.StructField("_corrupt_record", T.StringType())
    schema = T.StructType([*schemas.REPORT.fields, corrupt])
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Comparison reports: one document per file, or one per line of a written table.

    Documents that are cut, or name no instance, are no reports, see ``report_errors``.
    """
    reports = _reports(spark, path, multi_line)
    return reports.where("_corrupt_record is null and instance_id is not null").drop("_corrupt_record")


def report_errors(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The files with documents that are no reports."""
    reports = _reports(spark, path, multi_line).withColumn("path", F.col("_metadata.file_path"))
    message = F.when(F.col("_corrupt_record").isNotNull(), "Invalid JSON in report").when(
        F.col("instance_id").isNull(), "Report without instance"
    )
    return reports.select("path", F.lit("ReportError").alias("error_type"), message.alias("error_message")).where(
        "error_message is not null"
    )


def read_run_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and records of run indexes, one JSON object per file, of any length.

    The file is cut into its records, see ``large_json``, so a long index is read by as many tasks as it has blocks.
    Fails on a document that is no object or whose records are no list, when
    its rows are used.
    """
    rest, objects = large_json.read_list_in_object(spark, path, "records")
    parsed = F.try_parse_json("value")
    records = F.try_variant_get(parsed, "$.records", "variant")
    checked = rest.withColumn(
        "value",
        F.when(parsed.isNull(), F.raise_error(F.lit(NO_INDEX)))
        .when(~is_object(parsed), F.raise_error(F.lit("Index file must contain a JSON object")))
        .when(
            records.isNotNull() & ~F.schema_of_variant(records).startswith("ARRAY"),
            F.raise_error(F.lit("Index records must be a list")),
        )
        .otherwise(F.col("value")),
    )
    headers = checked.select("path", F.from_json("value", schemas.INDEX_HEADER).alias("i")).select("path", "i.*")
    sound = F.when(F.is_valid_utf8("value") & F.try_parse_json("value").isNull(), F.raise_error(F.lit(NO_INDEX))).otherwise(F.col("value"))
    found = objects.select("path", F.from_json(sound, schemas.INDEX_RECORD).alias("r"))
    return headers.drop("path"), found.join(headers.select("path", "run_id"), "path").select("run_id", "r.*")


def index_records(records: DataFrame) -> DataFrame:
    """Index records as the long form that the metrics take: one row per variant."""
    variants = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant"),
                F.try_element_at("variants", F.lit(v)).alias("r"),
            )
            for v in schemas.VARIANTS
        ]
    )
    return records.select("run_id", "instance_id", F.inline(variants)).select(
        "run_id", "instance_id", "variant", "r.*"
    )


def read_framework_cache(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, framework) of a JSON object; empty if it cannot be read.

    Keys that start with an underscore are notes, not instances.
    """
    document = read_documents(spark, path).select(F.from_json("value", schemas.TEXT_MAP).alias("m"))
    return document.select(F.explode("m").alias("instance_id", "framework")).where(~F.col("instance_id").startswith("_"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Dataset rows keyed by ``instance_id``, from Parquet or JSON lines."""
    return _read_table(spark, path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Model predictions, from Parquet or JSON lines, or a JSON array in ``.json``."""
    return _read_table(spark, path)


def _read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        segments = large_json.read_segments(spark, path)
        first = segments.select("value").first()
        if first is None or not first["value"].lstrip().startswith("["):
            return spark.read.option("multiLine", True).json(path)
        # A list, on one line or many, is read in as many tasks as it has blocks, into lines.
        lines = work_folder(spark, "list")
        large_json.read_objects(spark, path, segments).select("value").write.text(lines)
        return spark.read.json(lines)
    return spark.read.parquet(path)


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))
