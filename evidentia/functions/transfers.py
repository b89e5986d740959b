"""Background-transfer blobs and resource-usage id blobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import decode_utf16, le_bytes, swap_hex
from .text import dedupe_ignore_case

MIN_STRING = 4
_URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
_LOCAL = r"^([A-Za-z]:\\|\\\\)"
_SID = r"^S-1-[0-9]+(-[0-9]+)+$"


def utf16_strings(blob: Column) -> Column:
    """Printable runs of four or more UTF-16LE units, in blob order."""
    # Characters outside the basic plane and replacement marks end a run.
    runs = F.regexp_extract_all(decode_utf16(blob), F.lit("([\\x20-\\x7E\\x80-\\uD7FF\\uE000-\\uFFFC]{%d,})" % MIN_STRING), F.lit(1))
    return F.coalesce(runs, F.array().cast("array<string>"))


def is_likely_text(value: Column) -> Column:
    """At least four characters, four fifths of them printable ASCII."""
    ascii_count = F.length(F.regexp_replace(value, r"[^\x20-\x7E]", ""))
    return (F.length(value) >= MIN_STRING) & (ascii_count * 5 >= F.length(value) * 4)


def classify_strings(strings: Column) -> Column:
    """Struct ``urls, local_paths, owner_sids, names``, each without case-insensitive repeats."""
    urls = F.filter(strings, lambda s: s.rlike(_URL))
    paths = F.filter(strings, lambda s: ~s.rlike(_URL) & s.rlike(_LOCAL))
    others = F.filter(strings, lambda s: ~s.rlike(_URL) & ~s.rlike(_LOCAL) & is_likely_text(s))
    return F.struct(
        dedupe_ignore_case(urls).alias("urls"),
        dedupe_ignore_case(paths).alias("local_paths"),
        dedupe_ignore_case(F.filter(others, lambda s: s.rlike(_SID))).alias("owner_sids"),
        dedupe_ignore_case(F.filter(others, lambda s: ~s.rlike(_SID))).alias("names"),
    )


def app_string(blob: Column) -> Column:
    """UTF-16LE application id up to the first NUL."""
    return F.coalesce(F.substring_index(decode_utf16(blob), "\0", 1), F.lit(""))


def sid_string(blob: Column) -> Column:
    """Binary SID as ``S-1-…``; empty when the blob is too short for its own count."""
    count = le_bytes(blob, 1, 1).cast("int")
    authority = F.conv(F.hex(F.substring(blob, 3, 6)), 16, 10)
    parts = F.transform(
        F.when(count.between(1, 15), F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: _sub_authority(blob, i),
    )
    valid = (
        (F.octet_length(blob) >= 8) & (le_bytes(blob, 0, 1) == 1) & (count <= 15)
        & (F.octet_length(blob) >= 8 + 4 * count)
    )
    text = F.concat_ws("-", F.lit("S-1"), authority, parts)
    return F.when(F.coalesce(valid, F.lit(False)), text).otherwise(F.lit(""))


def _sub_authority(blob: Column, index: Column) -> Column:
    return F.conv(swap_hex(F.hex(F.substring(blob, index * 4 + 9, F.lit(4)))), 16, 10)
