"""Lookups and filters over events; each returns rows of its input unchanged."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import canonical_verb
from ..functions.bags import field, has_field
from ..functions.keys import file_key_text
from ..functions.text import icontains, is_blank


def _instant(value: dt.datetime | str) -> Column:
    return F.lit(value).cast("timestamp")


def time_range(events: DataFrame, start=None, end=None) -> DataFrame:
    """Closed interval on both ends; an open end is simply left out."""
    if start is not None:
        events = events.where(F.col("ts") >= _instant(start))
    if end is not None:
        events = events.where(F.col("ts") <= _instant(end))
    return events


def quick_range(name: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """``today``, ``last_24_hours`` or ``last_7_days`` as a closed interval."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "today":
        return midnight, midnight + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    spans = {"last_24_hours": dt.timedelta(hours=24), "last_7_days": dt.timedelta(days=7)}
    return now - spans[name], now


def by_process(events: DataFrame, key: str) -> DataFrame:
    return events.where(F.col("subject_process.key") == key)


def by_user(events: DataFrame, sid: str) -> DataFrame:
    return events.where(F.col("subject_user.sid") == sid)


def by_file(events: DataFrame, key_text: str) -> DataFrame:
    """Lookup by the text form of the file key."""
    return events.where(file_key_text(F.col("object_file")) == key_text)


def by_file_path(events: DataFrame, path: str) -> DataFrame:
    return events.where(F.col("object_file.path") == path)


def by_flow(events: DataFrame, key: str) -> DataFrame:
    return events.where(F.col("object_flow.key") == key)


def _equal(column: Column, value: str, ignore_case: bool) -> Column:
    return F.lower(column) == value.lower() if ignore_case else column == value


def by_category(events: DataFrame, category: str, ignore_case: bool = True) -> DataFrame:
    return events.where(_equal(F.col("category"), category, ignore_case))


def by_category_action(
    events: DataFrame, category: str, action: str, ignore_case: bool = True, normalize: bool = True
) -> DataFrame:
    verb = canonical_verb(action) if normalize else action
    return events.where(
        _equal(F.col("category"), category, ignore_case) & _equal(F.col("action"), verb, ignore_case)
    )


def by_field(events: DataFrame, name: str, value: str | None) -> DataFrame:
    """Events that carry the field with exactly this value; None matches a null value."""
    bag = F.col("fields")
    return events.where(has_field(bag, name) & field(bag, name).eqNullSafe(F.lit(value)))


def by_type(events: DataFrame, type_name: str, ignore_case: bool = True) -> DataFrame:
    """``Category.Action`` or just ``Category``."""
    category, _, action = type_name.partition(".")
    if action:
        return by_category_action(events, category, action, ignore_case)
    return by_category(events, category, ignore_case)


def by_protocol(events: DataFrame, protocol: str) -> DataFrame:
    return events.where(F.col("object_flow.protocol") == protocol)


def matches_text(text: str, extra: list[Column]) -> Column:
    """Substring, ignoring case, in any of the columns."""
    return reduce(lambda a, b: a | b, [icontains(c, text) for c in extra])


def full_text(events: DataFrame, text: str) -> DataFrame:
    """Summary, category, action or any field value contains the text."""
    if not text.strip():
        return events
    bag = F.exists(F.map_values("fields"), lambda v: icontains(v, text))
    columns = [F.col("summary"), F.col("category"), F.col("action")]
    return events.where(matches_text(text, columns) | F.coalesce(bag, F.lit(False)))


def category_like(events: DataFrame, text: str) -> DataFrame:
    return events.where(icontains(F.col("category"), text.strip())) if text.strip() else events


def action_like(events: DataFrame, text: str) -> DataFrame:
    return events.where(icontains(F.col("action"), text.strip())) if text.strip() else events


def process_like(events: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        return events
    return events.where(matches_text(text.strip(), [F.col("subject_process.key"), F.col("summary")]))


def path_like(events: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        return events
    columns = [F.col("object_file.path"), file_key_text(F.col("object_file")), F.col("summary")]
    return events.where(matches_text(text.strip(), columns))


@dataclass(frozen=True)
class ProcessRule:
    """One include or exclude rule over a process-inventory column."""

    action: str
    field: str
    operator: str
    value: str

    def matches(self, columns: dict[str, Column]) -> Column:
        """Boolean column; a blank value or an unknown field or operator never matches."""
        text = columns.get(self.field)
        if not self.value.strip() or text is None:
            return F.lit(False)
        left, right = F.lower(F.coalesce(text.cast("string"), F.lit(""))), self.value.lower()
        tests = {
            "Contains": F.contains(left, F.lit(right)),
            "Equals": left == right,
            "StartsWith": left.startswith(right),
            "EndsWith": left.endswith(right),
        }
        return tests.get(self.operator, F.lit(False))


# Rule field names and the inventory columns they read.
PROCESS_RULE_COLUMNS = {
    "ProcessName": "process_name",
    "PID": "pid",
    "User": "user_name",
    "CommandLine": "command_line",
    "ParentPID": "parent_pid",
    "Integrity": "integrity",
    "ImagePath": "image_path",
    "Company": "company",
    "Hash": "hash",
    "OwnerSid": "owner_sid",
    "SessionId": "session_id",
    "ParentImagePath": "parent_image_path",
    "Authenticode": "authenticode",
    "Operation": "last_operation",
    "Result": "last_result",
    "Path": "image_path",
}


def process_rules(
    rows: DataFrame, rules: list[ProcessRule], combine: str = "AND", columns: dict[str, str] | None = None
) -> DataFrame:
    """Include rules joined by AND or OR, then exclude rules; all become one predicate."""
    named = {k: F.col(v) for k, v in (columns or PROCESS_RULE_COLUMNS).items()}
    include = [r.matches(named) for r in rules if r.action == "Include"]
    exclude = [r.matches(named) for r in rules if r.action == "Exclude"]
    predicate = F.lit(True)
    if include:
        both = combine.upper() == "AND"
        predicate = reduce(lambda a, b: (a & b) if both else (a | b), include)
    for rule in exclude:
        predicate = predicate & ~rule
    return rows.where(predicate)


def startup_entries(entries: DataFrame, name: str = "entry_name") -> DataFrame:
    """Startup-folder entries without the folder's own metadata file."""
    return entries.where(F.lower(F.col(name)) != "desktop.ini")


def registry_search(
    values: DataFrame,
    key: str = "",
    recursive: bool = True,
    name_pattern: str | None = None,
    data_pattern: str | None = None,
) -> DataFrame:
    """Values below a key whose name and data match the patterns, ignoring case.

    Columns used: ``key_path, value_name, value_data``. Order lists are skipped.
    """
    kept = values.where((F.lower("value_name") != "mrulistex") & F.col("value_data").isNotNull())
    if key:
        path, root = F.lower(F.col("key_path")), key.lower()
        below = path.startswith(root + "\\") if recursive else F.lit(False)
        kept = kept.where((path == root) | below)
    if name_pattern:
        kept = kept.where(F.col("value_name").rlike("(?i)" + name_pattern))
    if data_pattern:
        kept = kept.where(F.col("value_data").rlike("(?i)" + data_pattern))
    return kept


def mft_filter(
    entries: DataFrame,
    record_index: str | None = None,
    file_name: str | None = None,
    path: str | None = None,
    in_use: bool | None = None,
    time_stomp_only: bool = False,
) -> DataFrame:
    if record_index is not None:
        entries = entries.where(F.contains(F.col("record_index").cast("string"), F.lit(record_index)))
    if file_name is not None:
        entries = entries.where(icontains(F.col("file_name"), file_name))
    if path is not None:
        entries = entries.where(icontains(F.col("full_path"), path))
    if in_use is not None:
        entries = entries.where(F.col("is_in_use") == in_use)
    if time_stomp_only:
        entries = entries.where(F.col("time_stomp_suspect"))
    return entries
