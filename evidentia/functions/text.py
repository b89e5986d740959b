"""Plain string helpers used by the other column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

# The white space trimmed from field text.
WHITE_SPACE = " \t\n\r\x0b\x0c\u0085\u00a0\u2003\u3000"

# Offensive command-line tokens, in report order.
SUSPICIOUS_TOKENS = [
    "-enc",
    "-encodedcommand",
    "frombase64string",
    "downloadstring",
    "downloadfile",
    "iex",
    "invoke-expression",
    "invoke-webrequest",
    "net.webclient",
    "-nop",
    "-noprofile",
    "-w hidden",
    "-windowstyle hidden",
    "hidden",
    "bypass",
    "-noni",
    "-noninteractive",
    "certutil",
    "bitsadmin",
    "mimikatz",
    "reflection.assembly",
    "frombase64",
    "start-process",
    "set-mppreference",
    "add-mppreference",
    "[char]",
    "downloadfileasync",
    "webclient",
]


def floor_div(value: Column, by: int) -> Column:
    """Exact integer division rounding down."""
    divisor = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def is_blank(value: Column) -> Column:
    """True for null, empty and all-white-space text; never null."""
    return F.coalesce(strip(value) == "", F.lit(True))


def not_blank(value: Column) -> Column:
    """The value itself, or null when it is blank."""
    return F.when(~is_blank(value), value)


def icontains(haystack: Column, needle: Column | str) -> Column:
    """Case-insensitive substring test; a null haystack counts as no match."""
    target = F.lower(F.lit(needle)) if isinstance(needle, str) else F.lower(needle)
    return F.coalesce(F.contains(F.lower(haystack), target), F.lit(False))


def clip(value: Column, limit: int, tail: str = "…") -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit(tail))).otherwise(value)


def dedupe_ignore_case(items: Column) -> Column:
    """First spelling of every distinct element, in order."""
    return F.filter(
        items,
        lambda item, i: F.array_position(F.transform(items, lambda x: F.lower(x)), F.lower(item)) == i + 1,
    )


def drop_controls(value: Column) -> Column:
    """File-name clean-up: control characters removed, ends trimmed."""
    return strip(F.regexp_replace(value, r"\p{Cntrl}", ""))


def rot13(value: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(
        value,
        upper + lower,
        upper[13:] + upper[:13] + lower[13:] + lower[:13],
    )


def suspicious_keywords(command: Column, tokens: list[str] | None = None) -> Column:
    """The tokens that occur in ``command``, in list order."""
    words = SUSPICIOUS_TOKENS if tokens is None else tokens
    lowered = F.lower(command)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lowered, F.lower(w)))
