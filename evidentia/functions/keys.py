"""Stable entity keys: build, format and parse.

Text forms: ``P:<boot hex>:<pid>:<time>``, ``U:<sid>``, ``R:<path>``,
``F:<volume>:<file id>`` or ``F:<path>[:<hash8>]``, and
``N:<proto>:<local>-><remote>:<pid>:<time>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bags import MAX_UINT32
from .text import let
from .times import format_iso, hour_bucket, parse_iso

UNKNOWN_PROTOCOL = "UNKNOWN"
_ISO_TAIL = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)$"


def _uint64(text: Column) -> Column:
    value = F.when(text.rlike(r"^\d{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), value)


def process_key_text(boot_id: Column, pid: Column, create_time_text: Column) -> Column:
    """Key text; the boot id is printed as upper-case hex without leading zeros."""
    boot_hex = F.conv(boot_id.cast("decimal(20,0)").cast("string"), 10, 16)
    return F.concat(F.lit("P:"), boot_hex, F.lit(":"), pid.cast("string"), F.lit(":"), create_time_text)


def process_key(boot_id: Column, pid: Column, create_time: Column) -> Column:
    """Process key struct; null when pid or create time is unknown."""
    built = F.struct(
        boot_id.cast("decimal(20,0)").alias("boot_id"),
        pid.cast("bigint").alias("pid"),
        create_time.cast("timestamp").alias("create_time"),
        process_key_text(boot_id, pid, format_iso(create_time)).alias("key"),
    )
    return F.when(pid.isNotNull() & create_time.isNotNull(), built)


def parse_process_key(text: Column) -> Column:
    pattern = r"^P:0*([0-9A-Fa-f]{1,16}):([0-9]+):(.+)$"
    boot = F.conv(F.regexp_extract(text, pattern, 1), 16, 10).try_cast("decimal(20,0)")
    pid = F.regexp_extract(text, pattern, 2).try_cast("bigint")
    created = parse_iso(F.regexp_extract(text, pattern, 3))
    valid = text.rlike(pattern) & pid.between(0, MAX_UINT32) & created.isNotNull()
    built = F.struct(boot.alias("boot_id"), pid.alias("pid"), created.alias("create_time"), text.alias("key"))
    return F.when(valid, built)


def user_key(sid: Column) -> Column:
    return F.when(sid.isNotNull(), F.struct(sid.alias("sid")))


def user_key_text(key: Column) -> Column:
    return F.concat(F.lit("U:"), key["sid"])


def parse_user_key(text: Column) -> Column:
    return user_key(F.when(text.startswith("U:"), F.substring(text, 3, 2**31 - 1)))


def registry_key(path: Column) -> Column:
    return F.when(path.isNotNull(), F.struct(path.alias("path")))


def registry_key_text(key: Column) -> Column:
    return F.concat(F.lit("R:"), key["path"])


def parse_registry_key(text: Column) -> Column:
    return registry_key(F.when(text.startswith("R:"), F.substring(text, 3, 2**31 - 1)))


def host_key_text(machine_sid: Column, hostname: Column) -> Column:
    return F.concat(F.lit("H:"), machine_sid, F.lit(":"), hostname)


def file_key(
    path: Column | None = None,
    hash_: Column | None = None,
    volume_serial: Column | None = None,
    file_id: Column | None = None,
) -> Column:
    nothing = F.lit(None)
    return F.struct(
        (nothing if volume_serial is None else volume_serial).cast("string").alias("volume_serial"),
        (nothing if file_id is None else file_id).cast("decimal(20,0)").alias("file_id"),
        (nothing if path is None else path).cast("string").alias("path"),
        (nothing if hash_ is None else hash_).cast("string").alias("hash"),
    )


def file_key_text(key: Column) -> Column:
    """Volume form if complete, else path with the first eight hash characters, else Unknown."""
    by_volume = key["volume_serial"].isNotNull() & key["file_id"].isNotNull()
    hash_tail = F.when(
        F.length(key["hash"]) > 0, F.concat(F.lit(":"), F.left(key["hash"], F.lit(8)))
    ).otherwise(F.lit(""))
    return F.when(
        key.isNotNull(),
        F.when(by_volume, F.concat(F.lit("F:"), key["volume_serial"], F.lit(":"), key["file_id"].cast("string")))
        .when(F.length(key["path"]) > 0, F.concat(F.lit("F:"), key["path"], hash_tail))
        .otherwise(F.lit("F:Unknown")),
    )


def parse_file_key(text: Column) -> Column:
    """The path form loses its decorative hash tail; the full hash is not in the text."""
    body = F.substring(text, 3, 2**31 - 1)
    volume_pattern = r"^([^:\\/]+):(\d+)$"
    file_id = _uint64(F.regexp_extract(body, volume_pattern, 2))
    path = F.regexp_replace(body, r"(?s)^(.+):[0-9A-Fa-f]{8}$", "$1")
    parsed = (
        F.when(body == "Unknown", file_key())
        .when(
            body.rlike(volume_pattern) & file_id.isNotNull(),
            file_key(volume_serial=F.regexp_extract(body, volume_pattern, 1), file_id=file_id),
        )
        .otherwise(file_key(path=path))
    )
    return F.when(text.startswith("F:"), parsed)


def flow_key(
    protocol: Column,
    local_ep: Column,
    remote_ep: Column,
    pid: Column,
    ts: Column,
    bucketed: bool = False,
) -> Column:
    """Flow key struct; ``ts`` is truncated to its hour unless already a bucket."""
    bucket = ts if bucketed else hour_bucket(ts)
    proto = F.coalesce(protocol, F.lit(UNKNOWN_PROTOCOL))
    local = F.coalesce(local_ep, F.lit(""))
    remote = F.coalesce(remote_ep, F.lit(""))
    return F.struct(
        proto.alias("protocol"),
        local.alias("local_ep"),
        remote.alias("remote_ep"),
        pid.cast("bigint").alias("pid"),
        bucket.cast("timestamp").alias("time_bucket"),
        flow_key_text(proto, local, remote, pid, bucket).alias("key"),
    )


def flow_key_text(protocol: Column, local_ep: Column, remote_ep: Column, pid: Column, bucket: Column) -> Column:
    return F.concat(
        F.lit("N:"),
        protocol,
        F.lit(":"),
        local_ep,
        F.lit("->"),
        remote_ep,
        F.lit(":"),
        F.coalesce(pid.cast("string"), F.lit("")),
        F.lit(":"),
        format_iso(bucket),
    )


def parse_flow_key(text: Column) -> Column:
    """Endpoints and times contain colons, so the tail is taken from the right."""
    pattern = r"^N:([^:]+?):(.+?)->(.+)$"
    tail = F.regexp_extract(text, pattern, 3)
    parts = F.struct(
        F.regexp_extract(tail, r"(?:^|:)" + _ISO_TAIL, 1).alias("time"), F.regexp_replace(tail, r":?" + _ISO_TAIL, "").alias("head")
    )
    return F.when(text.rlike(pattern), let(parts, lambda p: _flow_of(text, pattern, p["time"], p["head"])))


def _flow_of(text: Column, pattern: str, time_text: Column, head: Column) -> Column:
    pid_text = F.when(F.contains(head, F.lit(":")), F.regexp_extract(head, r":([^:]*)$", 1)).otherwise(F.lit(""))
    remote = F.when(F.contains(head, F.lit(":")), F.regexp_replace(head, r":[^:]*$", "")).otherwise(head)
    pid = F.when(pid_text.rlike(r"^\d{1,10}$"), pid_text.try_cast("bigint"))
    bucket = parse_iso(time_text)
    valid = bucket.isNotNull() & ((pid_text == "") | pid.between(0, MAX_UINT32))
    built = F.struct(
        F.regexp_extract(text, pattern, 1).alias("protocol"),
        F.regexp_extract(text, pattern, 2).alias("local_ep"),
        remote.alias("remote_ep"),
        pid.alias("pid"),
        bucket.alias("time_bucket"),
        text.alias("key"),
    )
    return F.when(valid, built)
