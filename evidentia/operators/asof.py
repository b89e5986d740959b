"""Which process an event belongs to: pid to create time, with lifetimes.

An event that states its create time starts an authoritative life of its pid.
Later events of the pid inherit it while each follows the previous one within
the time to live; a longer silence, or a Stop, ends it, and the next event
starts a provisional life at its own time. Long-lived images keep a third,
longer time to live.

The three lifetimes must not decrease (provisional, authoritative,
long-lived). Then the walk has a closed form over running maxima of the
arrival number, and a running maximum can be taken per chunk of arrivals and
carried over, so one pid may hold any share of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .ranking import lag_by_chunk, null_safe_join

# Default lifetimes in minutes per source.
EVENT_LOG_TTL = (720, 1440, 10_080)
TRACE_TTL = (30, 120, 10_080)
CHUNK = 1 << 20


def running_max(
    df: DataFrame, keys: list[str], seq: str, chunk: str, values: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Running maximum of each value along ``seq``; only chunk maxima cross chunks."""
    inside = Window.partitionBy(*keys, chunk).orderBy(seq)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumns({f"_l_{n}": F.max(v).over(inside) for n, v in values.items()})
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*keys, chunk).agg(*[F.max(v).alias(f"_m_{n}") for n, v in values.items()])
    carried = carried.select(*keys, chunk, *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    joined = null_safe_join(local, carried, [*keys, chunk], "left")
    merged = {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in values}
    return joined.withColumns(merged).drop(*[p + n for n in values for p in ("_l_", "_c_")])


def resolve_process_keys(
    events: DataFrame,
    ttl_minutes: tuple[int, int, int] = EVENT_LOG_TTL,
    keys: tuple[str, ...] | None = None,
    chunk_width: int = CHUNK,
    has_long_lived: bool = True,
    row_id: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add ``process_create_time``, ``resolution`` (explicit, provisional or cached) and ``life_seq``.

    Arrival numbers order one collection, so each collection of a host has its
    own lives: the keys are host, collection (if there is such a column) and pid,
    and a row is known by host, collection and arrival number.

    Needs ``keys``, ``ingest_seq``, ``ts``, ``create_hint`` (a stated create
    time or null), ``is_stop`` and ``is_long_lived``. The walk runs over these
    few columns only. Each stage reads its input twice (rows and chunk maxima),
    so the narrow rows are checkpointed between stages; the full events are
    joined once at the end by ``row_id``. A row with a null key column (an event
    without a pid) takes no part in the walk and stays unresolved.
    """
    bundle = tuple(c for c in ("host", "collection_id") if c in events.columns)
    keys, row_id = keys or (*bundle, "pid"), row_id or (*bundle, "ingest_seq")
    provisional, authoritative, long_lived = (m * 60_000_000 for m in ttl_minutes)
    if not provisional <= authoritative <= long_lived:
        raise ValueError("lifetimes must not decrease: provisional, authoritative, long-lived")
    key_list, seq = list(keys), "ingest_seq"
    chunk = F.call_function("div", F.col(seq), F.lit(chunk_width).cast("bigint"))
    names = list(dict.fromkeys([*keys, *row_id, seq]))
    rows = cut_lineage(
        events.select(
            *names,
            F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
            F.unix_micros(F.col("create_hint").cast("timestamp")).alias("_hint"),
            F.coalesce("is_stop", F.lit(False)).alias("_stop"),
            F.coalesce("is_long_lived", F.lit(False)).alias("_long"),
        )
    )
    # Filtered after the cut, so the optimizer cannot push the filter below the parsed fields and copy them into it.
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key_list if k not in ("host", "collection_id")], F.lit(True)))
    rows = lag_by_chunk(rows, key_list, [seq], chunk, ["_us", "_stop"], prefix="_prev")
    explicit, gap = F.col("_hint").isNotNull(), F.col("_gap")
    rows = rows.withColumns(
        {"_chunk": chunk, "_gap": F.when(~F.col("_prev_stop"), F.col("_us") - F.col("_prev_us"))}
    ).withColumn("_certain", explicit | gap.isNull() | (gap > long_lived))
    rows = cut_lineage(rows.drop("_prev_us", "_prev_stop"))

    certain = F.col("_certain")
    # Kind of a life at its start: 2 long-lived, 1 authoritative, 0 provisional.
    kind = F.when(F.col("_long"), F.lit(2)).when(explicit, F.lit(1)).otherwise(F.lit(0))
    rows = running_max(
        rows,
        key_list,
        seq,
        "_chunk",
        {
            "_anchor": F.when(certain, F.struct(F.col(seq).alias("seq"), kind.alias("kind"))),
            "_expired": F.when(~certain & (gap > authoritative), F.col(seq)),
        },
    )
    still_stated = (F.col("_anchor.kind") == 1) & ~F.coalesce(F.col("_expired") > F.col("_anchor.seq"), F.lit(False))
    candidate = ~certain & (F.col("_anchor.kind") != 2) & ~still_stated & (gap > provisional)
    starts = certain | F.col("_candidate")
    rows = cut_lineage(rows.withColumn("_candidate", candidate))
    if has_long_lived:
        rows = running_max(
            rows,
            key_list,
            seq,
            "_chunk",
            {"_absorbed": F.when(F.col("_candidate") & F.col("_long"), F.col(seq))},
            inclusive=False,
        )
        absorbed = F.coalesce(F.col("_absorbed") > F.col("_anchor.seq"), F.lit(False))
        rows = cut_lineage(rows.withColumn("_starts", certain | (F.col("_candidate") & ~absorbed)))
    else:
        rows = rows.withColumn("_starts", starts)
    life = F.struct(F.col(seq).alias("seq"), F.coalesce("_hint", "_us").alias("created"))
    rows = running_max(rows, key_list, seq, "_chunk", {"_life": F.when(F.col("_starts"), life)})
    resolution = (
        F.when(explicit, F.lit("explicit")).when(F.col("_starts"), F.lit("provisional")).otherwise(F.lit("cached"))
    )
    resolved = rows.select(
        *row_id,
        F.timestamp_micros("_life.created").alias("process_create_time"),
        resolution.alias("resolution"),
        F.col("_life.seq").alias("life_seq"),
    )
    return null_safe_join(events, resolved, list(row_id), "left")


def cache_stats(resolved: DataFrame, keys: tuple[str, ...] | None = None, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """Lives still cached at the end of the input: total, provisional and long-lived.

    A pid whose last event is a Stop has left the cache.
    """
    keys = keys or tuple(c for c in ("host", "collection_id", "pid") if c in resolved.columns)
    last = F.struct("is_stop", "life_seq")
    per_pid = resolved.groupBy(*keys).agg(F.max_by(last, "ingest_seq").alias("last"))
    lives = resolved.where(F.col("ingest_seq") == F.col("life_seq")).select(
        *keys,
        "life_seq",
        (F.col("resolution") == "provisional").alias("is_provisional"),
        F.col("is_long_lived").alias("life_long_lived"),
    )
    alive = per_pid.where(~F.col("last.is_stop")).select(*keys, F.col("last.life_seq").alias("life_seq"))
    return (
        alive.join(lives, [*keys, "life_seq"])
        .groupBy(*by)
        .agg(
            F.count("*").alias("total_entries"),
            F.count_if("is_provisional").alias("provisional_entries"),
            F.count_if("life_long_lived").alias("long_lived_entries"),
        )
    )

