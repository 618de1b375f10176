"""Temporary SQL functions with the meaning of the column functions; all are SQL expressions, no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from postmill.functions.privacy import PATTERNS
from postmill.functions.text import HTML_STEPS

_STRIP = r"regexp_replace({}, r'(?U)^\s+|\s+$', '')"


def _slug(x: str) -> str:
    dashed = f"regexp_replace(replace(lower({_STRIP.format(x)}), '&', ' and '), '[^a-z0-9]+', '-')"
    whole = f"coalesce(nullif(regexp_replace({dashed}, '^-+|-+$', ''), ''), 'untitled')"
    return f"coalesce(nullif(regexp_replace(substring({whole}, 1, 160), '-+$', ''), ''), 'untitled')"


def _scrub(x: str) -> str:
    for _, pattern, mark in PATTERNS:
        x = f"regexp_replace({x}, r'(?U){pattern}', '{mark}')"
    return x


def _html(x: str) -> str:
    for pattern, by in HTML_STEPS:
        x = f"regexp_replace({x}, r'{pattern}', {chr(39) + by.encode('unicode_escape').decode() + chr(39)})"
    return _STRIP.format(x)


FUNCTIONS = {
    "slugify": _slug("x"),
    "category_path": "coalesce(nullif(array_join(transform(filter(split(x, r'[/\\\\]+'), p -> "
                     + _STRIP.format("p") + " <> ''), p -> " + _slug("p") + "), '/'), ''), 'general')",
    "html_to_text": _html("x"),
    "scrub_text": _scrub("x"),
    "date_band": "coalesce(nullif(substring(x, 1, 4), ''), 'undated')",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; each takes and returns a string."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return list(FUNCTIONS)
