"""URL filters by dated lists: entries become validity intervals, and captures meet those that held when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intervals are cut at multiples of so many days, so that a pattern that very many captures meet, or that changes very
# often, is spread over as many keys as it has such spans.
SPAN_DAYS = 30
FOREVER = "9999-12-31 00:00:00"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
PATTERNS = "array<struct<kind:string,pattern:string,rank:int>>"


def host(url: Column) -> Column:
    """The host in lower case without user, port and a final dot; empty where there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def url_patterns(url: Column) -> Column:
    """All patterns that can list a URL, as (kind, pattern, rank), the most specific with the highest rank.

    ``url``: the URL itself. ``path``: the host and each leading run of whole path segments. ``domain``: the host and
    each domain above it. A text without a host has only itself.
    """
    at = host(url)
    labels = F.split(at, r"\.")
    # Leading empty text before the first slash is no segment.
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    entry = lambda kind, pattern, rank: F.struct(
        F.lit(kind).alias("kind"), pattern.alias("pattern"), rank.cast("int").alias("rank")
    )
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: entry("domain", F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."), n),
    )
    paths = F.when(
        F.size(segments) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(segments)),
            lambda n: entry("path", F.concat_ws("/", at, F.array_join(F.slice(segments, 1, n), "/")), 1000 + n),
        ),
    ).otherwise(F.array().cast(PATTERNS))
    itself = F.array(entry("url", url, F.lit(1_000_000)))
    return F.when(url.isNull(), F.array().cast(PATTERNS)).when(
        at == "", itself
    ).otherwise(F.concat(domains, paths, itself))


def intervals(changes: DataFrame) -> DataFrame:
    """Validity intervals ``since`` to ``until`` (not included) of entries.

    ``changes``: list_name, kind, pattern, listed (boolean), at (timestamp). The last change before a time holds; of
    changes at the same time delisting wins, and repeated changes are one. Rows with a null in one of the columns say
    nothing. Changes of one entry are put in order inside spans of days, and one row per span is carried across, so an
    entry may change any number of times.
    """
    entry = ["list_name", "kind", "pattern"]
    known = changes.select(*entry, "listed", "at").dropna()
    once = known.groupBy(*entry, "at").agg(F.min("listed").alias("listed"))
    spans = once.withColumn("_span", _span(F.col("at")))
    inside = Window.partitionBy(*entry, "_span").orderBy("at")
    across = Window.partitionBy(*entry).orderBy("_span")
    first = spans.groupBy(*entry, "_span").agg(F.min("at").alias("_first"))
    following = first.withColumn("_next", F.lead("_first").over(across)).drop("_first")
    until = F.coalesce(F.lead("at").over(inside), F.col("_next"), F.lit(FOREVER).cast("timestamp"))
    return (
        spans.join(following, [*entry, "_span"])
        .withColumn("until", until)
        .where("listed")
        .select(*entry, F.col("at").alias("since"), "until")
    )


def _span(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (SPAN_DAYS * 86400)).cast("long")


def filter_captures(captures: DataFrame, changes: DataFrame, capture_id: str, url: str, fetched: str) -> DataFrame:
    """One row per capture: ``capture_id``, ``n_active`` and the deciding entry, null where none holds.

    An entry meets a capture if one of the capture's patterns is its pattern and it is listed at the time of the fetch.
    The most specific entry decides; of equals the first by list name. Captures are told apart by id. A null URL has no
    patterns, and a null time is met by nothing: both give 0 entries. Extra columns are not looked at.
    """
    probes = captures.select(
        F.col(capture_id).alias("_id"), F.col(fetched).alias("_at"), F.explode(url_patterns(F.col(url))).alias("_p")
    ).select("_id", "_at", _span(F.col("_at")).alias("_span"), "_p.kind", "_p.pattern", "_p.rank")
    asked = captures.agg(F.min(_span(F.col(fetched))).alias("low"), F.max(_span(F.col(fetched))).alias("high")).first()
    # One row per span that both the interval and some capture can be in.
    low = F.greatest(_span(F.col("since")), F.lit(asked["low"]).cast("long"))
    high = F.least(_span(F.col("until")), F.lit(asked["high"]).cast("long"))
    asked_at_all = F.lit(asked["low"] is not None)
    entries = intervals(changes).withColumns({"_low": low, "_high": high}).where(asked_at_all & (low <= high))
    entries = entries.withColumn("_span", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    met = probes.join(entries, ["kind", "pattern", "_span"]).where(
        (F.col("since") <= F.col("_at")) & (F.col("_at") < F.col("until"))
    )
    # A capture has one pattern of each rank, and a list one interval of it at a time.
    entry = F.struct("list_name", "kind", "pattern", "since")
    found = met.groupBy("_id").agg(
        F.countDistinct("list_name", "kind", "pattern").alias("n_active"),
        F.min_by(entry, F.struct(-F.col("rank"), F.col("list_name"))).alias("_best"),
    )
    ids = captures.select(F.col(capture_id).alias("_id")).distinct()
    return ids.join(found, "_id", "left").select(
        F.col("_id").alias(capture_id),
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"),
        "_best.list_name",
        "_best.kind",
        "_best.pattern",
        "_best.since",
    )
