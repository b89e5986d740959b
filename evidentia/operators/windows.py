"""Per-second limits, arrival caps and look-ahead over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ranking import keep_newest, tie_names, top_n_per_key

# Default events per second and category, caps of the artifact tables.
THROTTLE_LIMITS = {"File": 500, "Registry": 300, "Network": 300}
EVENTS_PER_LOG = 20_000
VISITS_PER_DATABASE = 50_000
ROWS_PER_USAGE_TABLE = 100_000
FILE_TABLE_ROWS = 100_000
PROPERTIES_PER_EVENT = 20
STREAM_WINDOW = 1000
LOOKAHEAD_BLOCK = 64  # positions of a look-ahead block


def throttle_limits(max_per_second: int = 0, limits: dict[str, int] | None = None) -> dict[str, int] | None:
    """A positive common limit applies to every category (None); else the per-category ones."""
    return None if max_per_second > 0 else dict(limits or THROTTLE_LIMITS)


def throttle(
    events: DataFrame, max_per_second: int = 0, limits: dict[str, int] | None = None, keys: tuple[str, ...] = ("host",)
) -> DataFrame:
    """First-arrived events per category and calendar second, up to the limit.

    This is the calendar-aligned form; windows anchored at the first event are
    :mod:`evidentia.operators.throttle`. The literal bound lets Spark drop the
    surplus of a burst before the shuffle; categories without a limit never
    shuffle.
    """
    table = throttle_limits(max_per_second, limits)
    window = Window.partitionBy(*keys, "category", F.date_trunc("second", "ts")).orderBy("ingest_seq")
    if table is None:
        ranked = events.withColumn("_n", F.row_number().over(window))
        return ranked.where(F.col("_n") <= max_per_second).drop("_n")
    limited = F.col("category").isin(list(table))
    ranked = events.where(limited).withColumn("_n", F.row_number().over(window))
    within = (F.col("_n") <= max(table.values())) & (F.col("_n") <= _limit_of(table))
    return ranked.where(within).drop("_n").unionByName(events.where(~F.coalesce(limited, F.lit(False))))


def _limit_of(table: dict[str, int]) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, F.col("category"))


def throttle_drops(
    events: DataFrame, max_per_second: int = 0, limits: dict[str, int] | None = None, keys: tuple[str, ...] = ("host",)
) -> DataFrame:
    """Dropped events per category and second, from counts alone."""
    table = throttle_limits(max_per_second, limits)
    limit = F.lit(max_per_second) if table is None else _limit_of(table)
    per_second = events.groupBy(*keys, "category", F.date_trunc("second", "ts").alias("ts")).agg(
        F.count("*").alias("n")
    )
    return per_second.where(F.col("n") > limit).select(
        *keys, "category", "ts", (F.col("n") - limit).cast("bigint").alias("dropped")
    )


def stream_event_key(
    category: Column, action: Column, ts_text: Column, summary: Column, record_id: Column
) -> Column:
    """Identity of an event in the live stream."""
    parts = [category, action, ts_text, summary, record_id]
    return F.concat_ws(".", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def newest_distinct(events: DataFrame, key: Column, cap: int = STREAM_WINDOW, seq: str = "ingest_seq") -> DataFrame:
    """Newest ``cap`` distinct events: each key counts at its first arrival."""
    first = events.groupBy(key.alias("event_key")).agg(F.min(seq).alias(seq))
    return keep_newest(first, cap, seq)


def cap_per_group(
    rows: DataFrame, keys: list[str], cap: int, order: list[tuple[str, bool]] | None = None
) -> DataFrame:
    """First ``cap`` rows per group in the given order (arrival by default); 0 keeps everything."""
    if cap <= 0:
        return rows
    order = order or [("ingest_seq", False)]
    ties = [c for c in tie_names(rows, order) if c not in keys]
    return top_n_per_key(rows, keys, order, cap, rank="_rank", ties=ties).drop("_rank")


def truncated_groups(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Row count per group and whether the cap cuts it."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("row_count"))
    return counted.withColumn("truncated", (F.col("row_count") > cap) & F.lit(cap > 0))


def first_properties(properties: Column, cap: int = PROPERTIES_PER_EVENT) -> Column:
    return F.slice(properties, 1, cap)


def lookahead(
    rows: DataFrame, keys: list[str], pos: str, marker: Column, value: str, n: int, name: str = "next_values"
) -> DataFrame:
    """The next ``n`` values after every marker row, in order.

    ``pos`` numbers the rows of a group without gaps. Rows meet in blocks of
    positions, and the first ``n`` rows of a block also come to the one before
    it. So group size never matters: one file with a third of all rows is spread
    over its blocks. There is no join, whose side could be broadcast by mistake
    (the planner does not see how many rows an ``explode`` makes).
    """
    size = max(LOOKAHEAD_BLOCK, n)
    block = F.floor(F.col(pos) / size)
    blocks = F.when(F.pmod(F.col(pos), F.lit(size)) < n, F.array(block, block - 1)).otherwise(F.array(block))
    dealt = rows.withColumns({"_mark": F.when(marker, F.struct(*rows.columns)), "_own": block, "_blocks": blocks})
    dealt = dealt.select("*", F.explode("_blocks").alias("_block"))
    met = dealt.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(value).alias("value")))).alias("_rows"),
        F.collect_list(F.when(F.col("_block").eqNullSafe(F.col("_own")), F.col("_mark"))).alias("_marks"),
    )
    behind = lambda at: F.filter("_rows", lambda r: (r["pos"] > at) & (r["pos"] <= at + n))
    listed = F.transform("_marks", lambda m: F.struct(m.alias("mark"), F.transform(behind(m[pos]), lambda r: r["value"]).alias("ahead")))
    # The lists are made before the explode, so that no later expression copies the search into itself.
    return met.select(F.explode(listed).alias("_found")).select("_found.mark.*", F.col("_found.ahead").alias(name))
