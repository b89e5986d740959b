"""Access to the open ``fields`` map of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import string_map
from .text import let, not_blank

# Alias names tried in order for each derived field.
DERIVED_FIELDS = {
    "Result": ["Status", "Result", "NTStatus", "Outcome"],
    "Duration": ["Duration", "ElapsedTime", "Latency"],
    "ProcessName": ["ImageName", "ProcessName"],
    "ParentProcessId": ["ParentProcessId", "ParentPID"],
}
PARENT_PID_FIELDS = ["ParentProcessId", "ParentPID", "ParentPid", "PPID", "ParentProcessID"]

MAX_UINT32 = 4294967295
MAX_INT32 = 2147483647


def field(fields: Column, name: str) -> Column:
    """Value of one field, null where it is absent."""
    return fields.getItem(name)


def has_field(fields: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(fields, name), F.lit(False))


def first_field(fields: Column, *names: str) -> Column:
    """First non-blank value among ``names``, untrimmed; null if all are blank."""
    return F.coalesce(*[not_blank(field(fields, n)) for n in names])


def merge_fields(fields: Column, pairs: dict[str, Column], overwrite: bool = True) -> Column:
    """Add the non-null ``pairs`` to the map, with or without replacing present keys."""
    base = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    without = lambda left, right: F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))

    def merged(m: Column) -> Column:
        if overwrite:
            return F.map_concat(without(m["base"], m["new"]), m["new"])
        return F.map_concat(m["base"], without(m["new"], m["base"]))

    return let(F.struct(base.alias("base"), string_map(pairs).alias("new")), merged)


def _number(text: Column, low: int, high: int) -> Column:
    """Decimal or ``0x`` text as a BIGINT within ``[low, high]``; anything else is null."""
    hexadecimal = F.regexp_extract(text, r"^\s*0[xX]0*([0-9A-Fa-f]{1,8})\s*$", 1)
    value = F.coalesce(F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10), text).try_cast("bigint")
    return F.when(value.between(low, high), value)


def parse_pid(text: Column) -> Column:
    return _number(text, 0, MAX_UINT32)


def parse_port(text: Column) -> Column:
    return _number(text, -MAX_INT32 - 1, MAX_INT32)


def parse_int(text: Column) -> Column:
    return _number(text, -MAX_INT32 - 1, MAX_INT32)


def parent_pid(fields: Column) -> Column:
    """First parent-pid alias that parses; used as a parent only when it is positive."""
    return F.coalesce(*[parse_int(field(fields, n)) for n in PARENT_PID_FIELDS])


def normalize_trace_fields(fields: Column, opcode: Column) -> Column:
    """Fill Operation, Result, Duration, ProcessName and ParentProcessId from their aliases."""

    def filled(bag: Column) -> Column:
        pairs = {"Operation": not_blank(opcode)}
        pairs.update({target: first_field(bag, *names) for target, names in DERIVED_FIELDS.items()})
        return merge_fields(bag, pairs, overwrite=False)

    return let(fields, filled)


def authenticode_summary(fields: Column) -> Column:
    status = not_blank(field(fields, "AuthenticodeStatus"))
    publisher = not_blank(field(fields, "AuthenticodePublisher"))
    return F.concat_ws("; ", status, publisher)


