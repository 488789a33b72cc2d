"""Path functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import strip

PROJECT_ROOT = "/testbed"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    return path.contains("/tests/") | basename(path).startswith("test_")


def normalize_path(raw: Column, root: str = PROJECT_ROOT) -> Column:
    """``struct(path, error)``: one absolute form under ``root``, or why there is none.

    Takes an absolute path below the root or a path relative to it, drops empty
    and ``.`` segments and resolves ``..``. Symbolic links are not followed.
    """
    value = strip(raw)
    segments = F.filter(F.split(value, "/"), lambda s: ~s.isin("", "."))
    absolute = value.startswith("/")
    # Exactly two leading slashes name another root.
    double = value.rlike("^//(?!/)")
    joined = F.concat(F.lit("/"), F.array_join(segments, "/"))
    root_segments = F.array(*[F.lit(s) for s in root.strip("/").split("/")])
    full = F.when(absolute, segments).otherwise(F.concat(root_segments, segments))
    walked = F.concat(
        F.lit("/"),
        F.array_join(
            F.aggregate(
                full,
                F.array().cast("array<string>"),
                lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
                    F.concat(acc, F.array(s))
                ),
            ),
            "/",
        ),
    )
    # Most paths have no segment to drop or resolve and skip the walk over them.
    plain = ~value.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)|//|/\z")
    direct = F.when(absolute, value).otherwise(F.concat(F.lit(root + "/"), value))

    def inside(path: Column) -> Column:
        return (path == root) | path.startswith(root + "/")

    outside = F.concat(F.lit("Path outside project root: "), raw)
    error = (
        F.when(raw.isNull() | (value == ""), F.lit("Path cannot be empty"))
        .when(plain, F.when(~inside(direct), outside))
        .when(absolute & (double | ~inside(joined)), outside)
        .when(~inside(walked), outside)
    )
    resolved = F.when(plain, direct).otherwise(walked)
    return F.struct(F.when(error.isNull(), resolved).alias("path"), error.alias("error"))


def relative_to_root(path: Column, root: str = PROJECT_ROOT) -> Column:
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


def tree_entries(relative: Column) -> Column:
    """The folders above a file, and the file itself when it is a ``.py`` file."""
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folders = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    own = F.when(name.endswith(".py") & (name != ".py"), F.array(relative)).otherwise(F.array().cast("array<string>"))
    return F.concat(folders, own)
