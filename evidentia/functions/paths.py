"""Windows path text: leaf, extension, volume prefix, task names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip


def file_name(path: Column) -> Column:
    """Leaf after the last slash of either kind."""
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def extension(path: Column) -> Column:
    """Extension with its dot, empty where the leaf has none or ends in a dot."""
    return F.regexp_extract(path, r"(\.[^.\\/:]+)$", 1)


def leaf_segment(key_path: Column) -> Column:
    """Text after the last backslash, or the whole path if that would be empty."""
    leaf = F.regexp_extract(key_path, r"\\([^\\]+)$", 1)
    return F.when(leaf != "", leaf).otherwise(key_path)


def last_segment(key_path: Column) -> Column:
    """Last non-empty backslash segment, or empty text."""
    return F.regexp_extract(key_path, r"([^\\]+)\\*$", 1)


def is_rooted(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^([\\/]|[A-Za-z]:)"), F.lit(False))


def qualify_path(path: Column, drive: Column) -> Column:
    """Prefix the volume root; ``.`` and blank mean the root itself."""
    root = F.concat(F.upper(drive), F.lit(":\\"))
    bare = F.regexp_replace(strip(path), r"^\.\\", "")
    return (
        F.when(is_blank(path) | (path == "."), root)
        .when(F.substring(bare, 2, 1) == ":", bare)
        .when(bare.startswith("\\"), F.concat(F.upper(drive), F.lit(":"), bare))
        .otherwise(F.concat(root, bare))
    )


def task_path(path: Column) -> Column:
    """Comparable task path: backslashes, lower case, one leading and no trailing one."""
    body = F.rtrim(F.lower(F.translate(strip(path), "/", "\\")), F.lit("\\"))
    return F.when(body.startswith("\\"), body).otherwise(F.concat(F.lit("\\"), body))


def task_name_from_path(path: Column) -> Column:
    """Name below the last ``Tasks`` folder, else the leaf; always with a leading backslash."""
    below = F.translate(F.regexp_extract(path, r"(?i)^.*[\\/]Tasks[\\/](.+)$", 1), "/", "\\")
    return F.concat(F.lit("\\"), F.when(below != "", below).otherwise(file_name(path)))


def user_from_path(path: Column) -> Column:
    """Profile folder below ``Users``, else Unknown."""
    name = F.regexp_extract(path, r"(?i)(?:^|[\\/])Users[\\/]+([^\\/]+)", 1)
    return F.when(name != "", name).otherwise(F.lit("Unknown"))


def log_name_from_path(path: Column) -> Column:
    """Channel name of an exported log file; ``%4`` stands for a slash."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return F.when(is_blank(path) | (stem == ""), F.lit("OfflineEvtx")).otherwise(F.replace(stem, F.lit("%4"), F.lit("/")))


def normalize_sha1(raw: Column) -> Column:
    """Inventory hashes carry a 0000 prefix in front of the 40 digits."""
    return F.when((F.length(raw) == 44) & raw.startswith("0000"), F.substring(raw, 5, 40)).otherwise(raw)
