"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what Python's str.strip() and str.isspace() call white space.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion and not only U+0020."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def letters(text: Column) -> Column:
    """Number of alphabetic code points."""
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def symbols(text: Column) -> Column:
    """Number of code points that are neither alphanumeric nor white space."""
    return F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{SPACE}]+", ""))


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return text.isNotNull() & (text != "")


def ascii_borders(pattern: str) -> str:
    """``pattern`` with its word borders as RE2 reads them: in Java before 19 a letter beyond ASCII is a word character there."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
