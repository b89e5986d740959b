"""Evidence references: which raw files belong in a bundle and where they go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import file_name, is_rooted

# Evidence source, bundle sub-directory, pattern of allowed file names.
ARTIFACT_RULES = [
    ("Prefetch", "prefetch", r"\.pf$"),
    ("BrowserHistory", "browser", r"^(History|Archived History|places\.sqlite|WebCacheV01\.dat)$"),
    ("RecentLnk", "lnk", r"\.lnk$"),
    ("JumpList", "lnk", r"\.(automatic|custom)Destinations-ms$"),
    (
        "RegistryHive",
        "registry",
        r"^(SYSTEM|SOFTWARE|SAM|SECURITY|DEFAULT|NTUSER\.DAT|USRCLASS\.DAT|AMCACHE\.HVE)$",
    ),
    ("ScheduledTask", "tasks", r"^[^.]*\.?$|\.xml$"),
    ("PowerShellHistory", "powershell", r"^ConsoleHost_history\.txt$"),
    (
        "StartupFolder",
        "startup",
        r"\.(lnk|url|exe|com|scr|pif|bat|cmd|vbs|vbe|js|jse|wsf|wsh|ps1|hta|jar)$",
    ),
    ("EvtxFile", "evtx", r"\.evtx$"),
    ("SrumDb", "srum", r"\.dat$"),
    ("BitsDb", "bits", r"\.(db|dat)$"),
    ("WmiRepository", "wmi", r"\.data$"),
]
OTHER_DIRECTORY = "other"


def artifact_directory(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, directory, _ in ARTIFACT_RULES for x in (name, directory)])
    return F.coalesce(F.try_element_at(table, source), F.lit(OTHER_DIRECTORY))


def artifact_source_path(source: Column, reference: Column) -> Column:
    """Rooted file behind a reference; history references may end in a record number."""
    plain = F.when(
        source == "BrowserHistory", F.regexp_replace(reference, r"^(.{3,}):\d+$", "$1")
    ).otherwise(reference)
    known = source.isin([name for name, _, _ in ARTIFACT_RULES])
    return F.when(known & is_rooted(plain), plain)


def is_allowed_artifact(source: Column, path: Column) -> Column:
    allowed = F.lit(False)
    for name, _, pattern in ARTIFACT_RULES:
        hit = (source == name) & file_name(path).rlike("(?i)" + pattern)
        allowed = allowed | hit
    return F.coalesce(allowed, F.lit(False))


def rewrite_reference(reference: Column, copied: Column) -> Column:
    """Bundle-relative path where the file was copied, else the reference itself."""
    return F.when(F.length(F.btrim(copied)) > 0, copied).otherwise(reference)


def resolve_reference(reference: Column, base: Column) -> Column:
    """Absolute path of a ``raw/`` reference; references that climb out are left alone."""
    inside = reference.rlike(r"(?i)^raw[\\/]") & ~reference.rlike(r"(^|[\\/])\.\.([\\/]|$)")
    resolved = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.translate(reference, "\\", "/"))
    return F.when(F.coalesce(inside, F.lit(False)) & base.isNotNull(), resolved).otherwise(reference)
