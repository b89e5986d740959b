"""Browser history: visit labels and profile context from the database path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import user_from_path
from .text import icontains

# Labels of visit codes; other codes print as numbers.
CHROMIUM_TRANSITIONS = {
    0: "Link",
    1: "Typed",
    2: "Auto Bookmark",
    3: "Auto Subframe",
    4: "Manual Subframe",
    5: "Generated",
    6: "Start Page",
    7: "Form Submit",
    8: "Reload",
}
FIREFOX_VISITS = {
    1: "Link",
    2: "Typed",
    3: "Bookmark",
    4: "Embed",
    5: "Redirect Perm",
    6: "Redirect Temp",
    7: "Download",
}

# Path part that identifies each product.
CHROMIUM_PRODUCTS = {
    "\\Google\\Chrome\\": "Chrome (Chromium-based)",
    "\\Microsoft\\Edge\\": "Edge (Chromium-based)",
    "\\BraveSoftware\\Brave-Browser\\": "Brave (Chromium-based)",
    "\\Opera Software\\": "Opera (Chromium-based)",
}


def _label(table: dict[int, str], code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code.cast("int")), code.cast("bigint").cast("string"))


def chromium_visit_type(transition: Column) -> Column:
    """Core transition (low byte) as a label."""
    code = F.coalesce(transition, F.lit(0)).cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))
    return _label(CHROMIUM_TRANSITIONS, code)


def firefox_visit_type(code: Column) -> Column:
    return _label(FIREFOX_VISITS, F.coalesce(code, F.lit(0)))


def chromium_context(path: Column) -> Column:
    """Struct ``browser, user_profile, browser_profile``."""
    browser = F.lit("Chromium")
    for part, name in reversed(CHROMIUM_PRODUCTS.items()):
        browser = F.when(icontains(path, part), F.lit(name)).otherwise(browser)
    profile = F.regexp_extract(path, r"(?i)^.*\\(Profile [^\\]*)", 1)
    return F.struct(
        browser.alias("browser"),
        user_from_path(path).alias("user_profile"),
        F.when(profile != "", profile).otherwise(F.lit("Default")).alias("browser_profile"),
    )


def firefox_context(path: Column) -> Column:
    folder = F.regexp_extract(path, r"(?i)\\Mozilla\\Firefox\\Profiles\\([^\\]+)", 1)
    return F.struct(
        F.lit("Firefox").alias("browser"),
        user_from_path(path).alias("user_profile"),
        F.when(folder != "", folder).otherwise(F.lit("Default")).alias("browser_profile"),
    )
