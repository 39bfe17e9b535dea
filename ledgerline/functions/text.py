"""Text expressions: scrubbing, shapes, tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Patterns that must match the same strings as the scripts users come from.
OUTSIDE_WORD_SPACE_HYPHEN = r"[^\w\s-]"
DELIMITER_CHARS = "[~^]"
EMAIL = r"^[a-zA-Z0-9_+&*-]+(?:\.[a-zA-Z0-9_+&*-]+)*@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,7}$"
ID_SHAPE = r"[A-Za-z]+( [A-Za-z]+)*( -[A-Za-z]+)?\s*-\s*[A-Z]{3}-[0-9]+-[0-9]+-[A-Z]{3}"
ID_PREFIX = "^.*(?=-[^-]*-[^-]*$)"
VERSION = r"""version:\s*['"]?([^'"]+)['"]?"""
OUTER_ZEROS = "^0+|0+$"


def scrub(text: Column, rules: Iterable[tuple[str, str]] = (), drop: str | None = OUTSIDE_WORD_SPACE_HYPHEN) -> Column:
    """Apply (pattern, replacement) rules in order, then delete what ``drop`` matches."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, drop, "") if drop else text


def is_email(text: Column) -> Column:
    """True for a well-formed address; NULL and empty text are false."""
    # most text has no `@` and never reaches the pattern; `$` alone would accept a trailing line break
    return F.coalesce(text.contains("@") & ~text.endswith("\n") & text.rlike(EMAIL), F.lit(False))


def id_shape(text: Column) -> Column:
    """The first ``Words - AAA-9-9-AAA`` identifier, or NULL."""
    return F.nullif(F.regexp_extract(text, ID_SHAPE, 0), F.lit(""))


def id_prefix(text: Column) -> Column:
    """Text before the last two hyphen groups, or NULL when there are fewer."""
    return F.when(text.rlike(ID_PREFIX), F.regexp_extract(text, ID_PREFIX, 0))


def version_of(text: Column) -> Column:
    """Value of the first ``version:`` entry, or NULL."""
    return F.when(text.rlike(VERSION), F.regexp_extract(text, VERSION, 1))


def version_is(text: Column, expected: str) -> Column:
    """True when a version is present and equal to ``expected``."""
    return F.coalesce(version_of(text) == F.lit(expected), F.lit(False))


def strip_zeros(text: Column) -> Column:
    """Text without leading and trailing zeros."""
    return F.regexp_replace(text, OUTER_ZEROS, "")


def keep_if_contains(text: Column, token: str, default: str = "[]") -> Column:
    """The text when it holds ``token``, else ``default``."""
    return F.when(text.contains(token), text).otherwise(F.lit(default))


def is_blank(text: Column) -> Column:
    """True for text of spaces only (not for NULL)."""
    return F.trim(text) == F.lit("")


def path_as_name(path: Column) -> Column:
    """A path usable as a name: ``/`` becomes ``_``."""
    return F.replace(path, F.lit("/"), F.lit("_"))
