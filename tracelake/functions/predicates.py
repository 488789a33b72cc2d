"""Frame and instance predicates. Each returns a boolean Column for ``where``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers that tell project files from the rest.
SITE_PACKAGES = "site-packages"
TESTBED = "/testbed/"
CONFTEST = "/conftest.py"
STDLIB_MARKER = "/lib/python"


def not_frozen(file: Column | None = None) -> Column:
    file = _file(file)
    return ~(file.contains("<") | file.contains("frozen"))


def not_site_packages(file: Column | None = None) -> Column:
    return ~_file(file).contains(SITE_PACKAGES)


def not_stdlib(paths: Sequence[str] = (), file: Column | None = None) -> Column:
    """Python sources outside the standard library and any of the given folders."""
    file = _file(file)
    keep = file.endswith(".py") & ~file.contains(STDLIB_MARKER) & ~file.endswith(CONFTEST)
    for path in paths:
        if path:
            keep = keep & ~file.startswith(path)
    return keep


def testbed_only(marker: str = TESTBED, file: Column | None = None) -> Column:
    file = _file(file)
    return file.startswith(marker) & ~file.contains(SITE_PACKAGES)


def not_conftest(file: Column | None = None) -> Column:
    return ~_file(file).endswith(CONFTEST)


def in_function(name: str, func: Column | None = None) -> Column:
    return (F.col("func") if func is None else func) == name


def not_in_repos(repos: Sequence[str], instance_id: Column | None = None) -> Column:
    """Instances outside the given ``owner/name`` repositories."""
    instance_id = F.col("instance_id") if instance_id is None else instance_id
    keep = F.lit(True)
    for repo in repos:
        keep = keep & ~instance_id.startswith(repo.replace("/", "__"))
    return keep


def failing_tests_only(phase: Column, outcome: Column) -> Column:
    """Reports of the call phase that did not pass."""
    return (phase == "call") & (outcome != "passed")


def captured_unittest(event: Column, traceback: Column) -> Column:
    """Events of a unittest run that capture a failure: an error, a failure or a failing subtest with a traceback."""
    return event.isin("error", "failure", "subtest") & traceback.isNotNull()


def has_frames(frames: Column) -> Column:
    return F.coalesce(F.size(frames), F.lit(0)) > 0


def _file(file: Column | None) -> Column:
    return F.col("file") if file is None else file
