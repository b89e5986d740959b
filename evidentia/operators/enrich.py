"""Left joins that attach names to ids. The right side has one row per key.

No broadcast hint is given: Catalyst broadcasts by size, and beyond its
threshold adaptive execution splits hot keys of the left side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import mru_order
from ..functions.transfers import app_string, sid_string
from .ranking import last_by, null_safe_join

SID_ID_TYPE = 3


def srum_id_map(ids: DataFrame, order: str = "row_number") -> DataFrame:
    """``host, id_index, id_type, id_blob`` rows as one resolved value per id: the last by ``order`` that has one.

    Without such a column ids are taken to be unique.
    """
    value = F.when(F.coalesce(F.col("id_type"), F.lit(0)) == SID_ID_TYPE, sid_string(F.col("id_blob"))).otherwise(
        app_string(F.col("id_blob"))
    )
    return (
        ids.where(F.col("id_index").isNotNull())
        .groupBy("host", "id_index")
        .agg((F.max_by(value, F.when(value.isNotNull(), F.col(order))) if order in ids.columns else F.max(value)).alias("id_value"))
    )


def resolve_ids(
    rows: DataFrame, id_map: DataFrame, host: str = "host", app_id: str = "app_id", user_id: str = "user_id"
) -> DataFrame:
    """Add ``app`` and ``user_sid`` from the id map."""
    apps = id_map.select(F.col(host), F.col("id_index").alias(app_id), F.col("id_value").alias("app"))
    users = id_map.select(F.col(host), F.col("id_index").alias(user_id), F.col("id_value").alias("user_sid"))
    return rows.join(apps, [host, app_id], "left").join(users, [host, user_id], "left")


def visits_of_urls(urls: DataFrame, visits: DataFrame, url_id: str, visit_url: str) -> DataFrame:
    """Inner join of a history database's pages and visits, per host and database file."""
    right = visits.withColumnRenamed(visit_url, url_id)
    return urls.join(right, ["host", "database", url_id], "inner")


def with_dest_list(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Jump-list streams with their list entry by stream name, ignoring case; the last entry wins."""
    columns = [c for c in entries.columns if c not in ("host", "file_path", "stream_name", "seq")]
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    folded = (
        entries.where(F.length(F.trim("stream_name")) > 0)
        .groupBy("host", "file_path", F.lower("stream_name").alias("_stream"))
        .agg(last_by(packed, F.col("seq")).alias("_e"))
        .select("host", "file_path", "_stream", *[F.col(f"_e.{c}").alias(c) for c in columns])
    )
    keyed = items.withColumn("_stream", F.lower("stream_name"))
    return keyed.join(folded, ["host", "file_path", "_stream"], "left").drop("_stream")


def mru_ranks(order_lists: DataFrame, keys: tuple[str, ...] = ("host", "key_path"), raw: str = "value_raw") -> DataFrame:
    """One row per ranked value id of every ``MRUListEx``; a repeated id keeps its last rank."""
    exploded = order_lists.select(*keys, F.posexplode(mru_order(F.col(raw))).alias("rank", "value_id"))
    return exploded.groupBy(*keys, "value_id").agg(F.max("rank").alias("mru_order"))


def with_mru_rank(values: DataFrame, ranks: DataFrame, keys: tuple[str, ...] = ("host", "key_path")) -> DataFrame:
    """Attach the rank of a value whose name is the id."""
    name = F.when(F.col("value_name").rlike(r"^\d{1,9}$"), F.col("value_name").try_cast("bigint"))
    keyed = values.withColumn("value_id", name)
    return keyed.join(ranks, [*keys, "value_id"], "left").drop("value_id")


def entry_ordinals(entries: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Zero-based position of every element of an array column."""
    return entries.select(*keys, F.posexplode(items).alias("ordinal", "item"))


def multiset_match(truth: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: occurrences on both sides and how many pair up, counting repeats."""
    left = truth.groupBy(*keys).agg(F.count("*").alias("truth_count"))
    right = ours.groupBy(*keys).agg(F.count("*").alias("our_count"))
    joined = left.join(right, keys, "left")
    ours_n = F.coalesce(F.col("our_count"), F.lit(0))
    return joined.select(
        *keys, "truth_count", ours_n.alias("our_count"), F.least(F.col("truth_count"), ours_n).alias("matched")
    )


def coverage(matches: DataFrame, our_total: DataFrame) -> DataFrame:
    """Share of ground-truth rows matched and the row-count delta, as one row."""
    totals = matches.agg(F.sum("truth_count").alias("truth_rows"), F.sum("matched").alias("matched_rows"))
    ours = our_total.agg(F.count("*").alias("our_rows"))
    both = totals.withColumn("_one", F.lit(1)).join(ours.withColumn("_one", F.lit(1)), "_one").drop("_one")
    truth = F.col("truth_rows")
    return both.withColumns(
        {
            "coverage": F.when(truth > 0, F.col("matched_rows") / truth),
            "row_delta": F.when(truth > 0, F.abs(F.col("our_rows") - truth) / truth),
        }
    )


def rewrite_evidence(events: DataFrame, copied: DataFrame) -> DataFrame:
    """Replace evidence references by bundle-relative paths.

    ``copied`` has ``host, collection_id, reference, copied_path``: what a
    collection copied is nobody else's evidence. Only distinct references are
    joined; each event then maps its own list through the pairs it needs.
    """
    bundle, event = ["host", "collection_id"], ["host", "collection_id", "ingest_seq"]
    numbered = events.where(F.size("evidence") > 0).select(*event, F.posexplode("evidence").alias("_pos", "_ref"))
    folded = copied.groupBy(*bundle, F.lower("reference").alias("_folded")).agg(F.max("copied_path").alias("_copied"))
    keyed = numbered.withColumn("_folded", F.lower("_ref.reference"))
    joined = null_safe_join(keyed, folded, [*bundle, "_folded"], "left")
    rewritten = joined.select(
        *event,
        "_pos",
        F.col("_ref").withField(
            "reference",
            F.when(F.length(F.trim("_copied")) > 0, F.col("_copied")).otherwise(F.col("_ref.reference")),
        ).alias("_ref"),
    )
    lists = rewritten.groupBy(*event).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_ref"))).alias("_list")
    )
    return (
        null_safe_join(events, lists, event, "left")
        .withColumn(
            "evidence",
            F.coalesce(F.transform("_list", lambda e: e["_ref"]), F.col("evidence")),
        )
        .select(*events.columns)
    )
