"""Dataset joins: instances, predictions and the framework cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.classify import classify_framework, join_script
from tracelake.functions.predicates import not_in_repos

INSTANCE = "instance_id"


def select_instances(
    instances: DataFrame, ids: DataFrame | Sequence[str] | None = None, exclude_repos: Sequence[str] = ()
) -> DataFrame:
    """Instances among the given ids, if any are given, and outside the given repositories."""
    if isinstance(ids, DataFrame):
        # Distinct first: repeated ids are dropped before anything is shuffled.
        instances = instances.join(ids.select(INSTANCE).distinct(), INSTANCE, "left_semi")
    elif ids:
        instances = instances.where(F.col(INSTANCE).isin(*ids))
    return instances.where(not_in_repos(exclude_repos)) if exclude_repos else instances


def exclude_repo_table(instances: DataFrame, repos: DataFrame) -> DataFrame:
    """Instances outside a table of repositories (column ``repo``, ``owner/name``).

    Like the list form, an instance is out if its id starts with a repository's name. An id's beginnings are joined by
    equality, so the cost is that of the ids' lengths, not of the number of repositories.
    """
    excluded = repos.select(F.replace("repo", F.lit("/"), F.lit("__")).alias("_start")).dropna().distinct()
    beginnings = F.transform(F.sequence(F.lit(0), F.length(INSTANCE)), lambda n: F.left(F.col(INSTANCE), n))
    ids = instances.select(INSTANCE).distinct()
    out = ids.select(INSTANCE, F.explode(beginnings).alias("_start")).join(excluded, "_start", "left_semi")
    return instances.join(out.select(INSTANCE).distinct(), INSTANCE, "left_anti")


def latest_predictions(predictions: DataFrame, order: str = "ord", key: str = INSTANCE) -> DataFrame:
    """The last prediction of each instance. The order is found first, without the texts.

    Of several with the same order the one with the smallest hash of its columns, so that a repeated job finds the same.
    """
    last = predictions.groupBy(key).agg(F.max(order).alias(order))
    tied = predictions.join(last, [key, order], "left_semi")
    first = Window.partitionBy(key, order).orderBy(F.xxhash64(*predictions.columns))
    return tied.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def match_predictions(instances: DataFrame, predictions: DataFrame, order: str = "ord") -> DataFrame:
    """Instances with their last prediction; instances without one are left out."""
    return instances.join(latest_predictions(predictions, order), INSTANCE)


def missing_predictions(instances: DataFrame, predictions: DataFrame) -> DataFrame:
    """Instances that have no prediction."""
    return instances.join(predictions.select(INSTANCE).distinct(), INSTANCE, "left_anti")


def detect_framework(specs: DataFrame, cache: DataFrame | None = None, script: str = "eval_script") -> DataFrame:
    """The framework of each instance: cached, or told from its test commands.

    ``script`` is a text or an array of command lines; ``cache`` holds
    (instance_id, framework).
    """
    text: Column = F.col(script)
    if specs.schema[script].dataType.typeName() == "array":
        text = join_script(text)
    told = classify_framework(F.coalesce(text, F.lit("")))
    if cache is None:
        return specs.withColumn("framework", told)
    known = cache.select(INSTANCE, F.col("framework").alias("_cached"))
    return (
        specs.join(known, INSTANCE, "left").withColumn("framework", F.coalesce("_cached", told)).drop("_cached")
    )
