"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are cut off around values (white space, no-break and zero-width blanks), as characters and as a pattern.
BLANK_CHARS = " \t\n\x0b\x0c\r\u00a0\u2007\u202f\u200b\ufeff"
BLANKS = r"[\s\u00A0\u2007\u202F\u200B\uFEFF]"


def strip_blanks(c: Column) -> Column:
    """c without surrounding blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def key_of(c: Column) -> Column:
    """A reference as it is compared: trimmed, upper case; null where nothing is left."""
    k = F.upper(strip_blanks(c))
    return F.when(k != "", k)


def iso_day(c: Column) -> Column:
    """The calendar day of year-month-day with hyphens, four-digit year and one or two digits for month and day; else null."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.try_to_date(c, "yyyy-M-d"))
