"""Two views of the same thing: what one lists and the other does not.

Items are ``host, key, display, value, seq``. Keys compare ignoring case. The
two sides meet in one partial aggregation of their union instead of a full
outer join: one shuffle, and a repeated key is folded before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bags import field
from ..functions.paths import task_path
from ..functions.registry import (
    decode_dword,
    decode_utf16_hex,
    is_user_service,
    run_scope,
    service_labels,
)
from ..functions.text import is_blank, not_blank, strip
from ..schema import evidence_ref, string_map, to_events
from ..session import cut_lineage
from .filters import by_category
from .ranking import first_by, last_by

AMBER = 1


def last_wins(items: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """Keep the last-arrived row per key."""
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    return (
        items.groupBy(*keys)
        .agg(last_by(packed, F.col(seq)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
    )


def _met(live: DataFrame, offline: DataFrame) -> DataFrame:
    """Both sides per host and folded key, in one aggregation of their union."""
    columns = ["host", "key", "display", "value", "seq"]
    tagged = live.select(*columns, F.lit(True).alias("is_live")).unionByName(
        offline.select(*columns, F.lit(False).alias("is_live"))
    )
    kept = tagged.where(~is_blank(F.col("key")))
    shown = F.struct("display", "value")

    def side(is_live: bool, name: str) -> list[Column]:
        here = F.col("is_live") == is_live
        return [
            first_by(F.col("key"), F.col("seq"), where=here).alias(f"{name}_key"),
            last_by(shown, F.col("seq"), where=here).alias(name),
        ]

    grouped = kept.groupBy("host", F.lower("key").alias("folded")).agg(*side(True, "live"), *side(False, "offline"))
    return grouped.select(
        "host",
        *[F.col(f"{n}_key") for n in ("live", "offline")],
        *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("live", "offline") for c in ("display", "value")],
    )


def compare(
    category: str,
    live: DataFrame,
    offline: DataFrame,
    compare_values: bool = True,
    live_name: str = "live API",
    offline_name: str = "raw/offline source",
    require_both: bool = False,
) -> DataFrame:
    """Discrepancies between two item sets.

    With ``require_both`` a host that has no item at all on one side reports
    nothing, so an uncollected source does not flood the result.
    """
    differs = (
        (F.length("live_value") > 0)
        & (F.length("offline_value") > 0)
        & (F.lower("live_value") != F.lower("offline_value"))
    )
    kind = F.when(F.col("live_key").isNull(), F.lit("MissingFromLive")).when(
        F.col("offline_key").isNull(), F.lit("MissingFromOffline")
    )
    if compare_values:
        kind = kind.when(differs, F.lit("ValueMismatch"))
    rows = _met(live, offline).withColumn("kind", kind)
    if require_both:
        # One row per item by now: cheap to keep, and read by both the guard and the result.
        rows = cut_lineage(rows)
        sides = rows.groupBy("host").agg(
            F.count("live_key").alias("n_live"), F.count("offline_key").alias("n_offline")
        )
        guarded = sides.where((F.col("n_live") > 0) & (F.col("n_offline") > 0)).select("host")
        rows = rows.where(F.col("kind").isNotNull()).join(guarded, "host", "left_semi")
    only_offline = F.col("kind") == "MissingFromLive"
    mismatch = F.col("kind") == "ValueMismatch"
    display = F.when(only_offline, F.col("offline_display")).otherwise(F.col("live_display"))
    shown, label = F.concat(F.lit("'"), display, F.lit("'")), category.lower()
    detail = (
        F.when(
            only_offline,
            F.concat(
                shown,
                F.lit(
                    f" is present in the {offline_name} ({label}) but NOT in the {live_name}. "
                    "Possible hiding/tampering — or a disabled/removed entry. Investigate."
                ),
            ),
        )
        .when(
            mismatch,
            F.concat(
                shown,
                F.lit(f" differs between {live_name} and {offline_name} ({label}): '"),
                F.col("live_value"),
                F.lit("' vs '"),
                F.col("offline_value"),
                F.lit("'. Possible tampering. Investigate."),
            ),
        )
        .otherwise(
            F.concat(
                shown,
                F.lit(
                    f" is in the {live_name} but NOT in the {offline_name} ({label}). "
                    "Possible memory-only/injected item — or created after capture. Investigate."
                ),
            )
        )
    )
    return rows.where(F.col("kind").isNotNull()).select(
        "host",
        F.lit(category).alias("category"),
        "kind",
        F.lit(AMBER).alias("level"),
        F.when(only_offline, F.col("offline_key")).otherwise(F.col("live_key")).alias("key"),
        display.alias("display"),
        F.when(~only_offline, F.col("live_value")).alias("live_value"),
        F.when(only_offline | mismatch, F.col("offline_value")).alias("offline_value"),
        detail.alias("detail"),
    )


def _text(name: str) -> Column:
    return F.coalesce(field(F.col("fields"), name), F.lit(""))


def live_service_items(events: DataFrame) -> DataFrame:
    name = strip(_text("ServiceName"))
    return by_category(events, "Service").where(name != "").select(
        "host",
        F.lower(name).alias("key"),
        name.alias("display"),
        _text("ImagePath").alias("value"),
        F.col("ingest_seq").alias("seq"),
    )


def fold_services(values: DataFrame) -> DataFrame:
    """One row per service from one-value-per-row registry data.

    Needs ``host, service_name, image_path, type_label, service_type, seq``.
    """
    driver, process = service_labels(F.col("type_label"))
    decoded = values.select(
        "host",
        "seq",
        strip(F.col("service_name")).alias("name"),
        not_blank(decode_utf16_hex(F.col("image_path"))).alias("image"),
        decode_dword(F.col("service_type")).alias("number"),
        "type_label",
    )
    name, image, number = F.col("name"), F.col("image"), F.col("number")
    return (
        decoded.where(name != "")
        .groupBy("host", F.lower(name).alias("key"))
        .agg(
            F.min_by(name, F.col("seq")).alias("display"),
            last_by(image, F.col("seq"), where=image.isNotNull()).alias("value"),
            F.bool_or(driver).alias("is_driver"),
            F.bool_or(process).alias("is_process"),
            last_by(number, F.col("seq"), where=number.isNotNull()).alias("service_type"),
            F.max("seq").alias("seq"),
        )
    )


def offline_service_items(events: DataFrame) -> DataFrame:
    """User-mode services of a hive; drivers are left out."""
    values = (
        by_category(events, "Registry")
        .where(F.lower(_text("QueryName")) == "services")
        .select(
            "host",
            _text("ServiceName").alias("service_name"),
            _text("ServiceImagePath").alias("image_path"),
            _text("ServiceTypeLabel").alias("type_label"),
            _text("ServiceType").alias("service_type"),
            F.col("ingest_seq").alias("seq"),
        )
    )
    folded = fold_services(values)
    kept = is_user_service(F.col("is_driver"), F.col("is_process"), F.col("service_type"), F.col("value"))
    return folded.where(kept).select("host", "key", "display", "value", "seq")


def compare_services(events: DataFrame) -> DataFrame:
    return compare(
        "Service",
        live_service_items(events),
        offline_service_items(events),
        compare_values=False,
        require_both=True,
    )


def task_file_items(events: DataFrame) -> DataFrame:
    name = _text("TaskName")
    return by_category(events, "Persistence").where(~is_blank(name)).select(
        "host",
        task_path(name).alias("key"),
        strip(name).alias("display"),
        F.lit(None).cast("string").alias("value"),
        F.col("ingest_seq").alias("seq"),
    )


def task_cache_items(events: DataFrame) -> DataFrame:
    path = decode_utf16_hex(_text("TaskCache_Path"))
    return by_category(events, "Registry").where(~is_blank(path)).select(
        "host",
        task_path(path).alias("key"),
        strip(path).alias("display"),
        F.lit(None).cast("string").alias("value"),
        F.col("ingest_seq").alias("seq"),
    )


def compare_tasks(events: DataFrame) -> DataFrame:
    return compare(
        "ScheduledTask",
        task_file_items(events),
        task_cache_items(events),
        compare_values=False,
        live_name="on-disk Task XML",
        offline_name="TaskCache registry",
        require_both=True,
    )


def run_key_items(events: DataFrame, offline: bool) -> DataFrame:
    is_offline = F.lower(_text("Mode")) == "offline"
    scope, name = run_scope(field(F.col("fields"), "QueryName")), strip(_text("ValueName"))
    wanted = (is_offline if offline else ~is_offline) & scope.isNotNull() & (name != "")
    return by_category(events, "Registry").where(wanted).select(
        "host",
        F.lower(F.concat(scope, F.lit("|"), name)).alias("key"),
        F.concat(scope, F.lit("\\Run::"), name).alias("display"),
        decode_utf16_hex(_text("ValueData")).alias("value"),
        F.col("ingest_seq").alias("seq"),
    )


def compare_run_keys(events: DataFrame) -> DataFrame:
    return compare(
        "RunKey",
        run_key_items(events, offline=False),
        run_key_items(events, offline=True),
        compare_values=False,
        live_name="live registry API",
        offline_name="raw hive",
        require_both=True,
    )


def process_items(processes: DataFrame, name: str = "process_name", seq: str = "seq") -> DataFrame:
    """``host, pid, process_name`` rows as items; names lose ``.exe`` and case."""
    bare = F.regexp_replace(F.lower(name), r"\.exe$", "")
    pid = F.col("pid").cast("string")
    return processes.select(
        "host",
        pid.alias("key"),
        F.concat(bare, F.lit(" (PID "), pid, F.lit(")")).alias("display"),
        bare.alias("value"),
        F.col(seq).alias("seq"),
    )


def compare_processes(
    native: DataFrame, management: DataFrame, native_again: DataFrame, management_again: DataFrame
) -> DataFrame:
    """Process lists by pid; a finding must still hold in the second observation."""
    found = compare(
        "Process",
        process_items(native),
        process_items(management),
        compare_values=False,
        live_name="native process list (NtQuerySystemInformation)",
        offline_name="WMI Win32_Process",
        require_both=True,
    )

    def observed(table: DataFrame) -> DataFrame:
        return table.select("host", F.col("pid").cast("string").alias("key")).distinct()

    still_native = found.join(observed(native_again).withColumn("_native", F.lit(True)), ["host", "key"], "left")
    both = still_native.join(
        observed(management_again).withColumn("_management", F.lit(True)), ["host", "key"], "left"
    )
    hidden = (F.col("kind") == "MissingFromLive") & F.col("_native").isNull() & F.col("_management").isNotNull()
    extra = (F.col("kind") == "MissingFromOffline") & F.col("_management").isNull() & F.col("_native").isNotNull()
    return both.where(hidden | extra).select(*found.columns)


def anomaly_events(anomalies: DataFrame, ts: Column | None = None) -> DataFrame:
    """Findings as low-confidence events of category Anomaly."""
    when = F.current_timestamp() if ts is None else ts
    return to_events(
        anomalies,
        ts=when,
        category=F.lit("Anomaly"),
        action=F.lit("CrossSource"),
        summary=F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("detail")),
        fields=string_map(
            {
                "AnomalyKind": F.col("kind"),
                "AnomalyCategory": F.col("category"),
                "Key": F.col("key"),
                "Analyzer": "CrossSource",
                "Display": F.col("display"),
                "LiveValue": F.when(F.col("category") == "Service", F.col("live_value")),
                "OfflineValue": F.when(F.col("category") == "Service", F.col("offline_value")),
                "Detail": F.col("detail"),
            }
        ),
        evidence=F.array(
            evidence_ref(
                "CrossSourceAnalysis", F.concat(F.col("category"), F.lit(":"), F.col("key")), collected_at=when
            )
        ),
        confidence=F.lit("Low"),
    )
