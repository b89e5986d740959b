"""Action verbs: free text in, one of six canonical verbs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bags import merge_fields
from .text import strip

# Accepted raw actions per canonical verb; anything else is a Query.
VERB_ALIASES = {
    "Start": ["start"],
    "Stop": ["stop", "disconnect", "disconnected", "close"],
    "Open": ["open", "execute", "launch", "run", "visit"],
    "Write": ["write", "create", "set"],
    "Connect": ["connect", "listen", "connected"],
    "Query": ["query", "failed", "failure", "denied"],
}
DEFAULT_VERB = "Query"


def normalize_action(action: Column) -> Column:
    token = F.lower(strip(action))
    verb = F.lit(DEFAULT_VERB)
    for canonical, aliases in VERB_ALIASES.items():
        if canonical != DEFAULT_VERB:
            verb = F.when(token.isin(aliases), F.lit(canonical)).otherwise(verb)
    return verb


def canonical_verb(action: str) -> str:
    """The same mapping for a literal argument."""
    token = (action or "").strip().lower()
    for canonical, aliases in VERB_ALIASES.items():
        if token in aliases:
            return canonical
    return DEFAULT_VERB


def normalize_event(events: DataFrame) -> DataFrame:
    """Canonical ``action``; the raw one stays in ``fields.OriginalAction`` if it changed."""
    verb = normalize_action(F.col("action"))
    original = F.when(~verb.eqNullSafe(F.col("action")), F.coalesce(F.col("action"), F.lit("")))
    return events.withColumns(
        {
            "fields": merge_fields(F.col("fields"), {"OriginalAction": original}, overwrite=False),
            "action": verb,
        }
    )
