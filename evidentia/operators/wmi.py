"""Management-event subscriptions found in runs of printable text.

Runs are ``host, file, pos, run`` with ``pos`` counting the runs of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import lookahead

# Marker texts, patterns and look-ahead length.
BINDING_MARKER = "__FilterToConsumerBinding"
FILTER_MARKER = "__EventFilter"
LOOKAHEAD = 10
CONSUMER_PATTERN = r'^(\w*EventConsumer)\.Name="(.+)"$'
FILTER_PATTERN = r'^__EventFilter\.Name="(.+)"$'
QUERY_PATTERN = r"(?i)\bselect\b.+\bfrom\b"
NAMESPACE_PATTERN = r"(?i)^root\\"


def _last_match(runs: Column, pattern: str) -> Column:
    hits = F.filter(runs, lambda r: r.rlike(pattern))
    return F.get(hits, F.size(hits) - 1)


def _first_index(runs: Column, test) -> Column:
    """Zero-based index of the first run that passes, else null."""
    flags = F.transform(runs, lambda r, i: F.when(test(r, i), i))
    return F.array_min(flags)


def subscriptions(runs: DataFrame) -> DataFrame:
    """Bindings, filters and consumers, the first of each key per file."""
    # One run more than the look-ahead: the language follows the query text.
    ahead = lookahead(
        runs, ["host", "file"], "pos", F.col("run").isin(BINDING_MARKER, FILTER_MARKER), "run", LOOKAHEAD + 1, "ahead"
    ).select("host", "file", "pos", "run", "ahead")
    near = F.slice("ahead", 1, LOOKAHEAD)

    consumer = _last_match(near, CONSUMER_PATTERN)
    bound_filter = _last_match(near, FILTER_PATTERN)
    nothing = F.lit(None).cast("string")
    bindings = ahead.where((F.col("run") == BINDING_MARKER) & consumer.isNotNull() & bound_filter.isNotNull()).select(
        "host",
        "file",
        "pos",
        F.lit("Binding").alias("kind"),
        nothing.alias("name"),
        F.regexp_extract(consumer, CONSUMER_PATTERN, 1).alias("consumer_class"),
        F.regexp_extract(consumer, CONSUMER_PATTERN, 2).alias("consumer_name"),
        F.regexp_extract(bound_filter, FILTER_PATTERN, 1).alias("filter_name"),
        nothing.alias("namespace"),
        nothing.alias("query"),
        nothing.alias("query_language"),
    )

    # Each index is exploded out of an array of one: the planner copies nothing through that.
    namespace = F.array(_first_index(near, lambda r, i: r.rlike(NAMESPACE_PATTERN)))
    located = ahead.where(F.col("run") == FILTER_MARKER).select("*", F.explode(namespace).alias("_ns"))
    query = F.array(_first_index(near, lambda r, i: r.rlike(QUERY_PATTERN) & ~i.eqNullSafe(F.col("_ns"))))
    located = located.select("*", F.explode(query).alias("_query")).where(F.col("_query").isNotNull())
    has_namespace = F.col("_ns") < F.col("_query")
    language = F.get("ahead", F.col("_query") + 1)
    filters = located.select(
        "host",
        "file",
        "pos",
        F.lit("Filter").alias("kind"),
        F.when(has_namespace & (F.col("_ns") + 1 < F.col("_query")), F.get("ahead", F.col("_ns") + 1)).alias("name"),
        nothing.alias("consumer_class"),
        nothing.alias("consumer_name"),
        nothing.alias("filter_name"),
        F.when(has_namespace, F.get("ahead", F.col("_ns"))).alias("namespace"),
        F.get("ahead", F.col("_query")).alias("query"),
        F.when(language == "WQL", language).alias("query_language"),
    )

    consumers = runs.where(F.col("run").rlike(CONSUMER_PATTERN)).select(
        "host",
        "file",
        "pos",
        F.lit("Consumer").alias("kind"),
        nothing.alias("name"),
        F.regexp_extract("run", CONSUMER_PATTERN, 1).alias("consumer_class"),
        F.regexp_extract("run", CONSUMER_PATTERN, 2).alias("consumer_name"),
        nothing.alias("filter_name"),
        nothing.alias("namespace"),
        nothing.alias("query"),
        nothing.alias("query_language"),
    )
    found = bindings.unionByName(filters).unionByName(consumers)
    identity = {
        "Binding": ["consumer_class", "consumer_name", "filter_name"],
        "Filter": ["name", "query"],
        "Consumer": ["consumer_class", "consumer_name"],
    }
    key = F.lit("")
    for kind, columns in identity.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
        key = F.when(F.col("kind") == kind, text).otherwise(key)
    packed = F.struct(*[F.col(c) for c in found.columns if c not in ("host", "file", "kind", "pos")])
    return (
        found.groupBy("host", "file", "kind", key.alias("identity"))
        .agg(F.min("pos").alias("pos"), F.min_by(packed, "pos").alias("r"))
        .select("host", "file", "kind", "pos", "r.*")
    )
