"""Collection trust: rule packs over tables of bundle manifests.

Every rule is a column over one manifest row, so a repository of any size is
scored in one pass. Levels are 0 green, 1 amber, 2 red.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip, not_blank

GREEN, AMBER, RED = 0, 1, 2
LEVEL_NAMES = {GREEN: "Green", AMBER: "Amber", RED: "Red"}

# Manifest row: one flat struct; numbers may arrive as numeric text and are cast by the source.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("collection_id", T.StringType()),
        T.StructField("manifest_present", T.BooleanType()),
        T.StructField("integrity_status", T.StringType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("was_event_count_capped", T.BooleanType()),
        T.StructField("source_event_count", T.LongType()),
        T.StructField("exported_event_count", T.LongType()),
        T.StructField("event_cap", T.LongType()),
        T.StructField("trace_dropped_total", T.LongType()),
        T.StructField("render_dropped_total", T.LongType()),
        T.StructField("failed_evidence_count", T.LongType()),
        T.StructField("skipped_evidence_count", T.LongType()),
        T.StructField("was_artifact_copy_incomplete", T.BooleanType()),
        T.StructField("artifact_copy_warning", T.StringType()),
        T.StructField("copied_artifact_count", T.LongType()),
        T.StructField("evidence_count", T.LongType()),
        T.StructField("used_shadow_copy", T.BooleanType()),
        T.StructField("preflight_present", T.BooleanType()),
        T.StructField("preflight_errors", T.ArrayType(T.StringType())),
        T.StructField("preflight_warnings", T.ArrayType(T.StringType())),
        T.StructField("is_administrator", T.BooleanType()),
        T.StructField("registry_mode", T.StringType()),
        T.StructField("registry_live_enabled", T.BooleanType()),
        T.StructField("mode_profile", T.StringType()),
    ]
)

NEAR_CAPACITY = 0.9
MIN_FREE_BYTES = 512 * 1024 * 1024
DEFAULT_EVENT_CAP = 500_000

# Setting values that define the two named collection profiles.
MODE_PROFILES = {
    "forensic_strict": {
        "registry_offline_only": True,
        "live_registry_experimental": False,
        "trace_max_per_second": 300,
        "index_max_events": 200_000,
        "log_provisional_ttl_minutes": 720,
        "log_authoritative_ttl_minutes": 1440,
        "log_max_entries": 20_000,
        "trace_provisional_ttl_minutes": 30,
        "trace_authoritative_ttl_minutes": 120,
        "trace_max_entries": 50_000,
        "long_lived_ttl_minutes": 10_080,
    },
    "triage_fast": {
        "registry_offline_only": False,
        "live_registry_experimental": True,
        "trace_max_per_second": 800,
        "index_max_events": 100_000,
        "log_provisional_ttl_minutes": 240,
        "log_authoritative_ttl_minutes": 720,
        "log_max_entries": 12_000,
        "trace_provisional_ttl_minutes": 15,
        "trace_authoritative_ttl_minutes": 60,
        "trace_max_entries": 25_000,
        "long_lived_ttl_minutes": 4_320,
    },
}
CUSTOM_PROFILE = "custom"


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _signal(name: str, cases: list[tuple[Column | None, int, bool, Column | str]]) -> Column:
    """First case that holds decides level, unknown flag and detail."""
    level, unknown, detail = F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for condition, case_level, case_unknown, text in reversed(cases):
        text = F.lit(text) if isinstance(text, str) else text
        if condition is None:
            level, unknown, detail = F.lit(case_level), F.lit(case_unknown), text
        else:
            holds = F.coalesce(condition, F.lit(False))
            level = F.when(holds, F.lit(case_level)).otherwise(level)
            unknown = F.when(holds, F.lit(case_unknown)).otherwise(unknown)
            detail = F.when(holds, text).otherwise(detail)
    return F.struct(
        F.lit(name).alias("signal"), level.alias("level"), unknown.alias("is_unknown"), detail.alias("detail")
    )


def _signal_columns() -> list[Column]:
    c = F.col
    failed = F.coalesce(c("failed_evidence_count"), F.lit(0))
    skipped = F.coalesce(c("skipped_evidence_count"), F.lit(0))
    lost = c("source_event_count") - c("exported_event_count")
    copy_parts = F.concat_ws(
        "; ",
        F.when(skipped > 0, _words(_number(skipped), " skipped")),
        not_blank(c("artifact_copy_warning")),
    )
    nothing_to_copy = (F.coalesce(c("copied_artifact_count"), F.lit(0)) <= 0) & (
        F.coalesce(c("evidence_count"), F.lit(0)) <= 0
    )
    errors, warnings = c("preflight_errors"), c("preflight_warnings")
    n_errors, n_warnings = F.coalesce(F.size(errors), F.lit(0)), F.coalesce(F.size(warnings), F.lit(0))
    is_live = F.coalesce(F.lower("registry_mode") == "live_non_forensic", F.lit(False)) | F.coalesce(
        c("registry_live_enabled"), F.lit(False)
    )
    profile = not_blank(c("mode_profile"))
    return [
        _signal(
            "Integrity",
            [
                (c("integrity_status") == "Verified", GREEN, False, "hashes.txt verified against bundle contents."),
                (
                    c("integrity_status") == "Unverified", AMBER, False,
                    "Bundle could not be hash-verified (hashes.txt missing or unreadable).",
                ),
                (None, RED, False, "Hash verification FAILED — bundle may be tampered with or corrupted."),
            ],
        ),
        _signal(
            "Bundle completeness",
            [
                (c("complete"), GREEN, False, "Export finished and marked complete."),
                (~c("complete"), RED, False, "Manifest marks the bundle as NOT complete — export did not finish."),
                (None, AMBER, True, "No completeness marker; bundle may predate the 'complete' flag."),
            ],
        ),
        _signal(
            "Event truncation",
            [
                (
                    c("was_event_count_capped") & lost.isNotNull(), RED, False,
                    _words(
                        "Event count was capped: ", _number(lost), " of ", _number(c("source_event_count")),
                        " events were NOT exported (cap ",
                        F.coalesce(_number(c("event_cap")), F.lit("")), ").",
                    ),
                ),
                (
                    c("was_event_count_capped"), RED, False,
                    _words(
                        "Event count was capped at the export limit (",
                        F.coalesce(_number(c("event_cap")), F.lit("")), "); some events were not exported.",
                    ),
                ),
                (
                    ~c("was_event_count_capped") & c("exported_event_count").isNotNull(), GREEN, False,
                    _words("All ", _number(c("exported_event_count")), " source events exported; no cap hit."),
                ),
                (~c("was_event_count_capped"), GREEN, False, "No event cap was hit."),
                (
                    None, AMBER, True,
                    "Cap state unknown (source event count not recorded); "
                    "cannot confirm the full timeline was exported.",
                ),
            ],
        ),
        _signal(
            "ETW completeness",
            [
                (
                    c("trace_dropped_total").isNull(), AMBER, True,
                    "ETW drop total not recorded; cannot confirm no high-frequency events were lost.",
                ),
                (
                    c("trace_dropped_total") <= 0, GREEN, False,
                    "No ETW events were dropped by throttling/ingest backpressure.",
                ),
                (
                    None, AMBER, False,
                    _words(
                        _number(c("trace_dropped_total")),
                        ' ETW event(s) dropped (throttle/BurstQueue). "Not seen" does not mean "not present."',
                    ),
                ),
            ],
        ),
        _signal(
            "UI render backpressure",
            [
                (
                    c("render_dropped_total").isNull(), GREEN, False,
                    "No UI-backpressure drops recorded (does not affect persisted timeline).",
                ),
                (c("render_dropped_total") <= 0, GREEN, False, "No UI render events were dropped."),
                (
                    None, AMBER, False,
                    _words(
                        _number(c("render_dropped_total")),
                        " live render event(s) dropped for responsiveness. Persisted timeline is unaffected; "
                        "live view may have looked incomplete during bursts.",
                    ),
                ),
            ],
        ),
        _signal(
            "Raw artifact copy",
            [
                (
                    failed > 0, RED, False,
                    _words(
                        _number(failed),
                        " evidence file(s) FAILED to copy into raw/; "
                        "those raw artifacts are missing from the bundle.",
                    ),
                ),
                (
                    ((skipped > 0) | c("was_artifact_copy_incomplete")) & (copy_parts != ""), AMBER, False,
                    _words(
                        "Artifact copy incomplete (", copy_parts,
                        "). Some evidence references have no bundled raw file.",
                    ),
                ),
                (
                    c("was_artifact_copy_incomplete"), AMBER, False,
                    "Artifact copy reported incomplete; some evidence references have no bundled raw file.",
                ),
                (None, GREEN, False, "All referenced raw artifacts copied into the bundle."),
            ],
        ),
        _signal(
            "VSS artifact source",
            [
                (nothing_to_copy, GREEN, False, "No raw artifacts required copying."),
                (
                    c("used_shadow_copy"), GREEN, False,
                    "Raw artifacts copied from a VSS shadow copy (locked-file safe).",
                ),
                (
                    ~c("used_shadow_copy"), AMBER, False,
                    "Raw artifacts copied from live paths (no VSS); "
                    "locked or in-use files may have been skipped or changed during copy.",
                ),
                (None, AMBER, True, "VSS usage for artifact copy not recorded."),
            ],
        ),
        _signal(
            "Preflight",
            [
                (~F.coalesce(c("preflight_present"), F.lit(False)), AMBER, True, "No preflight section recorded."),
                (
                    n_errors > 0, RED, False,
                    _words(
                        "Preflight reported ", n_errors.cast("string"), " error(s): ",
                        clip(F.array_join(errors, "; "), 240),
                    ),
                ),
                (
                    n_warnings > 0, AMBER, False,
                    _words(
                        "Preflight reported ", n_warnings.cast("string"), " warning(s): ",
                        clip(F.array_join(warnings, "; "), 240),
                    ),
                ),
                (None, GREEN, False, "Preflight passed with no warnings or errors."),
            ],
        ),
        _signal(
            "Privilege",
            [
                (c("is_administrator"), GREEN, False, "Collected with Administrator privileges."),
                (
                    ~c("is_administrator"), AMBER, False,
                    "Not Administrator: some hives, protected event logs, handles, "
                    "or drivers may have been inaccessible.",
                ),
                (None, AMBER, True, "Privilege level not recorded."),
            ],
        ),
        _signal(
            "Registry mode",
            [
                (
                    is_live, AMBER, False,
                    "Live Registry was enabled (non-forensic). "
                    "Prefer Offline Hive data as the forensic baseline.",
                ),
                (
                    not_blank(c("registry_mode")).isNotNull() | ~c("registry_live_enabled"), GREEN, False,
                    "Offline-only registry (forensic baseline).",
                ),
                (None, AMBER, True, "Registry mode not recorded."),
            ],
        ),
        _signal(
            "Mode profile",
            [
                (profile.isNull(), AMBER, True, "Mode profile not recorded."),
                (
                    F.lower(profile) == CUSTOM_PROFILE, AMBER, False,
                    "Custom profile: stable-baseline assumptions may not apply.",
                ),
                (None, GREEN, False, _words("Mode profile: ", profile, ".")),
            ],
        ),
    ]


def trust_signals(manifests: DataFrame) -> DataFrame:
    """One row per bundle and signal.

    The integrity signal appears only where a status is known; a missing or
    unreadable manifest yields a single red Manifest signal beside it.
    """
    columns = {f.name: f.dataType for f in MANIFEST_SCHEMA}
    full = manifests.select(
        *[
            (F.col(n) if n in manifests.columns else F.lit(None)).cast(t).alias(n)
            for n, t in columns.items()
        ]
    )
    missing = _signal(
        "Manifest",
        [(None, RED, False, "manifest.json is missing or unreadable; collection trust cannot be assessed.")],
    )
    integrity, *rest = _signal_columns()
    known = F.when(F.col("integrity_status").isNotNull(), F.array(integrity)).otherwise(F.array().cast(
        "array<struct<signal:string,level:int,is_unknown:boolean,detail:string>>"
    ))
    body = F.when(F.coalesce(F.col("manifest_present"), F.lit(True)), F.array(*rest)).otherwise(F.array(missing))
    return full.select("host", "collection_id", F.explode(F.concat(known, body)).alias("s")).select(
        "host", "collection_id", "s.*"
    )


def trust_overall(signals: DataFrame) -> DataFrame:
    """Worst level per bundle (unknown counts as amber at least) and red and amber counts."""
    effective = F.when(F.col("is_unknown"), F.greatest(F.col("level"), F.lit(AMBER))).otherwise(F.col("level"))
    return signals.groupBy("host", "collection_id").agg(
        F.max(effective).alias("overall_level"),
        F.count_if(F.col("level") == RED).alias("red_count"),
        F.count_if(F.col("level") == AMBER).alias("amber_count"),
    )


def known_limitations(document: Column) -> Column:
    """Limitations of a manifest document as a list, from an array, an object or a string."""
    raw = F.get_json_object(document, "$.knownLimitations")
    items = F.from_json(raw, T.ArrayType(T.StringType()))
    entries = F.map_entries(F.from_json(raw, T.MapType(T.StringType(), T.StringType())))
    named = F.transform(
        entries,
        lambda e: F.when(e["value"].rlike(r"^[\[{]|^(true|false|null|-?\d+(\.\d+)?)$"), e["key"]).otherwise(
            F.concat(e["key"], F.lit(": "), e["value"])
        ),
    )
    listed = (
        F.when(raw.startswith("["), items)
        .when(raw.startswith("{"), named)
        .when(raw.isNotNull(), F.array(raw))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(listed, lambda s: F.length(F.trim(s)) > 0)


def completeness(count: Column, cap: Column, evicted: Column, render_dropped: Column) -> Column:
    """Struct ``level, is_losing_data, headline``: eviction first, then near-cap, then render drops."""
    threshold = F.floor(cap.cast("double") * F.lit(NEAR_CAPACITY)).cast("bigint")
    percent = F.floor(count * F.lit(100) / F.when(cap > 0, cap)).cast("bigint")
    full, near, dropped = evicted > 0, (cap > 0) & (count >= threshold), render_dropped > 0
    level = F.when(full, F.lit(RED)).when(near | dropped, F.lit(AMBER)).otherwise(F.lit(GREEN))
    headline = (
        F.when(full, _words("⚠ Index full — ", _number(evicted), " oldest event(s) dropped from memory"))
        .when(near, _words("Index ~", percent.cast("string"), "% full — eviction imminent"))
        .when(dropped, _words("Live view dropped ", _number(render_dropped), " render event(s)"))
        .otherwise(F.lit("Collection complete"))
    )
    return F.struct(
        level.alias("level"), F.coalesce(full, F.lit(False)).alias("is_losing_data"), headline.alias("headline")
    )


def mode_profile(settings: dict[str, Column] | None = None) -> Column:
    """Named profile whose every setting matches, else custom."""
    label = F.lit(CUSTOM_PROFILE)
    for name, values in reversed(MODE_PROFILES.items()):
        match = F.lit(True)
        for setting, wanted in values.items():
            column = F.col(setting) if settings is None else settings[setting]
            match = match & column.eqNullSafe(F.lit(wanted))
        label = F.when(match, F.lit(name)).otherwise(label)
    return label


def preflight_warnings(
    is_admin: Column,
    use_shadow_copy: Column,
    raw_hive_sources: Column,
    shadow_service_running: Column,
    registry_live: Column,
    profile: Column,
    free_bytes: Column,
    minimum_bytes: int = MIN_FREE_BYTES,
) -> Column:
    """Distinct warnings raised by the reported facts, in check order."""
    checks = [
        (
            free_bytes < minimum_bytes,
            f"Available free space is below the recommended minimum ({minimum_bytes} bytes).",
        ),
        (
            ~is_admin & (use_shadow_copy | (raw_hive_sources > 0)),
            "Administrator privileges are recommended or required for some configured collection paths.",
        ),
        (
            use_shadow_copy & ~shadow_service_running,
            "VSS-backed export is enabled, but the Volume Shadow Copy service is not running.",
        ),
        (registry_live, "Live Registry is enabled; this mode is non-forensic."),
        (profile == CUSTOM_PROFILE, "Custom profile is active; stable baseline assumptions may not apply."),
    ]
    raised = F.array(*[F.when(condition, F.lit(text)) for condition, text in checks])
    return F.filter(raised, lambda w: w.isNotNull())


def merge_warnings(first: Column, second: Column) -> Column:
    """Ordered distinct union of two lists without blanks."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(first, empty), F.coalesce(second, empty))
    return F.array_distinct(F.filter(both, lambda w: F.length(F.trim(w)) > 0))


def consistency_scope(hives: DataFrame, keys: list[str], path: str = "hive_path", snapshot: str = "from_snapshot") -> DataFrame:
    """SingleLive, SingleSnapshot or Mixed over the distinct hive files of a collection."""
    distinct = hives.groupBy(*keys, F.lower(path).alias("_path")).agg(F.bool_or(snapshot).alias("_snapshot"))
    taken, total = F.count_if("_snapshot"), F.count("*")
    scope = (
        F.when(taken == 0, F.lit("SingleLive")).when(taken == total, F.lit("SingleSnapshot")).otherwise(F.lit("Mixed"))
    )
    return distinct.groupBy(*keys).agg(scope.alias("consistency_scope"), total.alias("hive_count"))


def collection_summary(
    events: DataFrame,
    keys: list[str],
    source_counts: DataFrame | None = None,
    event_cap: int = DEFAULT_EVENT_CAP,
) -> DataFrame:
    """Exported events and evidence per collection; ``was_capped`` is null without a source count."""
    counted = events.groupBy(*keys).agg(
        F.count("*").alias("exported_event_count"),
        F.sum(F.coalesce(F.size("evidence"), F.lit(0))).cast("bigint").alias("evidence_count"),
    )
    if source_counts is None:
        counted = counted.withColumn("source_event_count", F.lit(None).cast("bigint"))
    else:
        counted = counted.join(source_counts, keys, "left")
    return counted.select(
        *keys,
        "source_event_count",
        "exported_event_count",
        F.lit(event_cap).cast("bigint").alias("event_cap"),
        (F.col("source_event_count") > F.col("exported_event_count")).alias("was_event_count_capped"),
        "evidence_count",
    )


def drop_totals(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Dropped events per category with the latest report, plus a grand total even when zero."""
    last = F.struct(F.col("dropped").alias("dropped"), F.col("ts").alias("ts"))
    per_category = reports.groupBy(*keys, "category").agg(
        F.sum("dropped").cast("bigint").alias("total_drops"),
        F.max_by(last, "ts").alias("_last"),
    )
    return per_category.select(
        *keys,
        "category",
        "total_drops",
        F.col("_last.dropped").cast("bigint").alias("last_reported_drops"),
        F.col("_last.ts").alias("last_report"),
    )


def drop_grand_total(reports: DataFrame) -> DataFrame:
    return reports.agg(F.coalesce(F.sum("dropped"), F.lit(0)).cast("bigint").alias("dropped_event_total"))
