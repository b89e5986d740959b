"""Time decoding and formatting; every timestamp is UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bags import field
from .text import floor_div

# Epoch distances of the foreign clocks.
FILETIME_UNIX_EPOCH = 116_444_736_000_000_000  # 100 ns ticks, 1601 to 1970
CHROMIUM_UNIX_EPOCH_MICROS = 11_644_473_600_000_000  # microseconds, 1601 to 1970
MIN_MICROS = -62_135_596_800_000_000  # year 1
MAX_MICROS = 253_402_300_799_999_999  # year 9999

# Plausible years per artifact.
RUN_ARTIFACT_YEARS = (1990, 2038)
REGISTRY_ARTIFACT_YEARS = (2000, 2100)
JUMP_LIST_YEARS = (1970, 2100)

# Names of a process create-time field, in lookup order per source.
EVENT_LOG_CREATE_FIELDS = [
    "CreationUtcTime",
    "ProcessStartTime",
    "ProcessStartTimeUtc",
    "ProcessCreationTime",
    "StartTime",
    "CreateTime",
]
TRACE_CREATE_FIELDS = [
    "ProcessStartTime",
    "ProcessStartTimeUtc",
    "ProcessCreationTime",
    "StartTime",
    "CreateTime",
    "CreationUtcTime",
]

_ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2})?\s*$"


def micros_to_ts(micros: Column) -> Column:
    """Microseconds since 1970 as TIMESTAMP, null outside years 1 to 9999."""
    return F.when(micros.between(MIN_MICROS, MAX_MICROS), F.timestamp_micros(micros.cast("bigint")))


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 as TIMESTAMP; negative or out-of-range values are null."""
    value = ticks.cast("decimal(20,0)")
    bounded = F.when(value.between(0, (MAX_MICROS * 10) + FILETIME_UNIX_EPOCH + 9), value).cast("bigint")
    return F.timestamp_micros(floor_div(bounded - FILETIME_UNIX_EPOCH, 10))


def filetime_checked(ticks: Column, years: tuple[int, int]) -> Column:
    """FILETIME kept only when positive and inside the plausible years."""
    value = ticks.cast("decimal(20,0)")

    def ticks_at(year: int) -> int:
        epoch = dt.datetime(1970, 1, 1)
        return int((dt.datetime(year, 1, 1) - epoch).total_seconds()) * 10_000_000 + FILETIME_UNIX_EPOCH

    return F.when((value >= ticks_at(years[0])) & (value < ticks_at(years[1] + 1)), filetime(value))


def filetime_not_sentinel(ticks: Column) -> Column:
    """FILETIME of a file-table record: 0, -1 and the extremes of int64 mean no time."""
    value = ticks.cast("decimal(20,0)")
    return F.when((value > 0) & (value < 2**63 - 1), filetime(value))


def unix_seconds(value: Column) -> Column:
    bounded = F.when(value.between(MIN_MICROS // 1_000_000, MAX_MICROS // 1_000_000), value.cast("bigint"))
    return F.timestamp_seconds(bounded)


def unix_millis(value: Column) -> Column:
    bounded = F.when(value.between(MIN_MICROS // 1000, MAX_MICROS // 1000), value.cast("bigint"))
    return F.timestamp_millis(bounded)


def chromium_time(micros_since_1601: Column) -> Column:
    return micros_to_ts(micros_since_1601 - CHROMIUM_UNIX_EPOCH_MICROS)


def firefox_time(micros_since_1970: Column) -> Column:
    """Microseconds cut to whole milliseconds."""
    return unix_millis(floor_div(micros_since_1970.cast("bigint"), 1000))


def to_utc(ts: Column, kind: Column | str = "Unspecified", local_zone: str = "UTC") -> Column:
    """UTC and unspecified times are kept; local ones are shifted out of ``local_zone``."""
    label = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(label == "Local", F.to_utc_timestamp(ts, local_zone)).otherwise(ts)


def parse_iso(text: Column) -> Column:
    """ISO text as TIMESTAMP (digits past the microsecond are dropped); otherwise null."""
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def iso_ticks(text: Column) -> Column:
    """100 ns ticks since 1970 of ISO text, exact to the seventh digit."""
    seventh = F.regexp_extract(text, r"\.\d{6}(\d)", 1)
    extra = F.when(seventh != "", seventh.try_cast("bigint")).otherwise(F.lit(0))
    return F.unix_micros(parse_iso(text)) * 10 + extra


def format_iso(ts: Column) -> Column:
    """Round-trip text with seven fraction digits, the last always zero."""
    return F.concat(F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))


def format_display(ts: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss.SSS")


def format_second(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))


def guess_time(text: Column) -> Column:
    """FILETIME, Unix milliseconds, Unix seconds or ISO text, told apart by magnitude."""
    number = text.try_cast("bigint")
    micros = (
        F.when(number > FILETIME_UNIX_EPOCH, floor_div(number - FILETIME_UNIX_EPOCH, 10))
        .when(number.between(1_000_000_000_000, 32_503_680_000_000), number * 1000)
        .when(number.between(1_000_000_000, 32_503_680_000), number * 1_000_000)
    )
    return F.coalesce(micros_to_ts(micros), parse_iso(text))


def create_time_field(fields: Column, names: list[str] | None = None) -> Column:
    """First field among ``names`` that holds a time."""
    texts = F.array(*[field(fields, n) for n in names or EVENT_LOG_CREATE_FIELDS])
    present = F.filter(texts, lambda t: t.isNotNull())
    return F.get(F.filter(F.transform(present, guess_time), lambda t: t.isNotNull()), F.lit(0))


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)
