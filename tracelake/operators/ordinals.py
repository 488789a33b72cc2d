"""Running positions, sums and previous values inside groups of any size, and their first rows.

An ordinary group is numbered by a window over its keys: one shuffle. A hot group, one with more rows than a task should
take, is cut into slices at approximate quantiles of its order column; the window runs inside the slices, and one small
row per slice carries what the slices before it hold. Hot groups are found by a count over the key columns alone. Each
holds more than ``HOT_SHARE`` of all rows, so there are fewer of them than its inverse however large the data is, and
their quantiles and carried rows can be broadcast: no join moves the table a second time, and with no hot group adaptive
execution drops these joins.

Keys may be null; null is a group like any other, as in a window. ``order`` is one column or several, nulls first. The
first one must be a number or a time and cuts the hot groups; rows that agree in it stay in one slice. Rows that agree
in all of ``order`` get any order among them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1 << 20
HOT_SHARE = 1 / 1024
SLICES = 256
# Spark's default for the largest rank by which it limits a window before the shuffle.
GROUP_LIMIT = 1000

Order = str | Sequence[str]


def sequence_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    name: str,
    total: str | None = None,
    sums: Mapping[str, Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``name``: the 0-based position of each row inside its group, and ``total``: the rows of the group.

    ``sums`` adds columns with the sum of an amount over the rows before; a null amount counts as 0.
    """
    by = _columns(order)
    amounts = {out: F.coalesce(amount, F.lit(0)) for out, amount in (sums or {}).items()}
    bounds = _bounds(df, keys, by[0], rows_per_task)
    within = Window.partitionBy(*keys, "_slice").orderBy(*by)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    numbered = _sliced(df, bounds, keys, by[0], "left").withColumns(
        {"_within": F.row_number().over(within)}
        | {f"_in_{out}": F.coalesce(F.sum(amount).over(earlier), F.lit(0)) for out, amount in amounts.items()}
        | ({"_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_slice"))} if total else {})
    )
    carried = _carried(_sliced(df, bounds, keys, by[0], "inner"), keys, amounts)
    met = _meet(numbered, carried, [*keys, "_slice"], "left")
    before = F.coalesce("_before", F.lit(0))
    added = [(before + F.col("_within") - 1).cast("bigint").alias(name)]
    added += [(F.col(f"_in_{out}") + F.coalesce(f"_before_{out}", F.lit(0))).alias(out) for out in amounts]
    if total:
        added.append(F.coalesce("_total", "_rows").alias(total))
    return met.select(*df.columns, *added)


def leading_rows(df: DataFrame, keys: Sequence[str], order: Order, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first ``n`` rows of each group.

    For the numbers that Spark limits a window by before its shuffle, every task sends at most ``n`` rows of a group, so no
    group is hot. For larger ones the slices of a hot group that cannot hold them are dropped before the shuffle.
    """
    by = _columns(order)
    if n <= GROUP_LIMIT and rows_per_task == ROWS_PER_TASK:
        return _first_rows(df, keys, by, n)
    bounds = _bounds(df, keys, by[0], rows_per_task)
    counts = _carried(_sliced(df, bounds, keys, by[0], "inner"), keys, {})
    # A slice is needed if fewer than n rows come before it; slices are numbered in order.
    last = counts.where(F.col("_before") < n).groupBy(*keys).agg(F.max("_slice").alias("_needed"))
    cut = _meet(_sliced(df, bounds, keys, by[0], "left"), last, keys, "left")
    needed = cut.where(F.col("_slice").isNull() | (F.col("_slice") <= F.col("_needed")))
    return _first_rows(needed, keys, by, n).select(*df.columns)


def _first_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_within", within).where(F.col("_within") <= n).drop("_within")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Order, value: str, name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``name``: ``value`` of the row before, null on the first row of a group."""
    by = _columns(order)
    bounds = _bounds(df, keys, by[0], rows_per_task)
    within = Window.partitionBy(*keys, "_slice").orderBy(*by)
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = (
        _sliced(df, bounds, keys, by[0], "inner")
        .groupBy(*keys, "_slice")
        # A struct keeps a last value that is null.
        .agg(F.max_by(F.struct(value), F.struct(*by)).alias("_last"))
        .select(*keys, "_slice", F.lag("_last").over(across).alias("_carried"))
    )
    lagged = _sliced(df, bounds, keys, by[0], "left").withColumns(
        {"_lag": F.lag(value).over(within), "_first": F.row_number().over(within) == 1}
    )
    return (
        _meet(lagged, carried, [*keys, "_slice"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")[value]).otherwise(F.col("_lag")))
        .select(*df.columns, name)
    )


def _columns(order: Order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _bounds(df: DataFrame, keys: Sequence[str], order: str, rows_per_task: int) -> DataFrame:
    """The hot groups with the quantiles that cut them; no rows in the common case."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bound = F.greatest(F.lit(rows_per_task), F.ceil(counts.agg(F.sum("_n")).scalar() * HOT_SHARE))
    hot = counts.withColumn("_bound", bound).where(F.col("_n") > F.col("_bound")).select(*keys)
    at = F.percentile_approx(order, [n / SLICES for n in range(1, SLICES)])
    quantiles = _meet(df.select(*keys, order), hot.withColumn("_hot", F.lit(True)), keys, "inner")
    # Without any value to cut at there is one slice.
    return quantiles.groupBy(*keys).agg(F.coalesce(at, F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>")).alias("_at"))


def _sliced(df: DataFrame, bounds: DataFrame, keys: Sequence[str], order: str, how: str) -> DataFrame:
    """Add ``_slice``: how many quantiles a row is past, null outside of hot groups. ``inner`` has only those."""
    past = F.size(F.filter("_at", lambda at: at < F.col(order)))
    slice_ = F.when(F.col("_at").isNotNull(), F.coalesce(past, F.lit(0))).cast("int")
    return _meet(df, bounds, keys, how).withColumn("_slice", slice_).drop("_at")


def _carried(sliced: DataFrame, keys: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """Per slice of a hot group, the rows and sums of the slices before it: at most ``SLICES`` rows a group."""
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(amount).alias(f"_n_{out}") for out, amount in amounts.items()]
    )

    def before(part: str) -> Column:
        return F.coalesce(F.sum(part).over(earlier), F.lit(0))

    return parts.select(
        *keys,
        "_slice",
        before("_n").alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        *[before(f"_n_{out}").alias(f"_before_{out}") for out in amounts],
    )


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` with the other columns of the small table ``right``, where null keys meet null keys."""
    names = {k: f"_key_{n}" for n, k in enumerate(keys)}
    small = F.broadcast(right.withColumnsRenamed(names))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    return left.join(small, same, how).drop(*names.values())
