"""Column expressions for identifiers and words that stand for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of Unicode, with the zero-width space, the word joiner and the byte order mark.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\u200b\u2060\ufeff"

# Words and signs written where there is no value.
NO_VALUE = ("", "-", "--", "?", ".", "n/a", "na", "#n/a", "nan", "nil", "none", "null", "unknown", "undefined", "tbd", "pending", "missing", "not available", "\\n", "(null)", "<null>", "\u2014", "\u2013")


def stripped(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def reference_key(text: Column) -> Column:
    """The form in which ids compare: no outer white space, one letter case; null for null and blank ids."""
    key = F.lower(stripped(text))
    return F.when(key != "", key)


def usable_text(text: Column) -> Column:
    """True where the text is a value and not null, blank or a word or sign for "no value"."""
    return F.coalesce(~F.lower(stripped(text)).isin(*NO_VALUE), F.lit(False))
