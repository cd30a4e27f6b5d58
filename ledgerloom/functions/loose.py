"""Reading of loosely written values and of replies that hold JSON somewhere, without failing on any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contract phrases of unit bases; tokens are the phrases with underscores.
BASES = ("per hour", "per day", "per night", "per visit", "per item", "per test", "per procedure", "per unit dispensed", "per hour per item")


def lenient_integer(c: Column) -> Column:
    """A whole number with or without thousands marks; null for fractions, words and truth values."""
    s = F.regexp_replace(F.trim(c), ",", "")
    return F.when(s.rlike(r"\A-?[0-9]{1,18}(?:\.0+)?\z"), F.regexp_replace(s, r"\.0+$", "")).try_cast("long")


def lenient_fraction(c: Column) -> Column:
    """A share written as 0.2, 20 or 20%: what has a percent sign or is over 1 is divided by 100; null if it is no number."""
    s = F.regexp_replace(F.trim(c), r"[%\s,]", "")
    n = F.when(s.rlike(r"\A[0-9]{1,9}(?:\.[0-9]{1,6})?\z"), s).try_cast("decimal(16,6)")
    return F.when(F.contains(c, F.lit("%")) | (n > 1), n / 100).otherwise(n).cast("decimal(16,6)")


def canonical_basis(c: Column) -> Column:
    """The invoice token of a unit basis in any spelling (blanks, hyphens, case); null if it is none."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", " ")
    s = F.when(s.startswith("per "), s).otherwise(F.concat(F.lit("per "), s))
    return F.when(s.isin(*BASES), F.regexp_replace(s, " ", "_"))


def json_payload(c: Column) -> Column:
    """The JSON object or list of a reply as a variant: the whole, a fenced block, or the outermost braces; null if none parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    whole = F.when(F.trim(c).rlike(r"^[\[{]"), c)
    return F.coalesce(F.try_parse_json(whole), F.try_parse_json(F.when(fenced != "", fenced)), F.try_parse_json(F.when(braces != "", braces)))


def payload_kind(c: Column) -> Column:
    """How a reply wraps its JSON: plain, fenced, chatty or none."""
    whole = F.try_parse_json(F.when(F.trim(c).rlike(r"^[\[{]"), c)).isNotNull()
    fenced = c.rlike(r"(?s)```.*```")
    return F.when(c.isNull() | json_payload(c).isNull(), "none").when(whole, "plain").when(fenced, "fenced").otherwise("chatty")


def lenient_day(c: Column) -> Column:
    """A day from the first ten characters; null if they are none."""
    return F.try_to_date(F.regexp_extract(F.trim(c), r"\A([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1), "yyyy-M-d")


def money_forms(cents: Column) -> Column:
    """The ways an amount may be written: 123456, 123,456, 1234.56 and 1,234.56."""
    whole, rest = F.floor(cents / 100), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    return F.array(cents.cast("string"), F.format_number(cents, 0), F.concat_ws(".", whole.cast("string"), rest), F.concat_ws(".", F.format_number(whole, 0), rest))


def states_any(text: Column, forms: Column) -> Column:
    """Whether a text has one of the forms, not inside a longer number."""
    return F.exists(forms, lambda f: F.rlike(text, F.concat(F.lit(r"(?<![0-9.,])"), F.regexp_replace(f, r"\.", r"\\."), F.lit(r"(?![0-9]|[.,][0-9])"))))


#: Numbers as words.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def percent_forms(share: Column) -> Column:
    """The ways a share may be written: 7.5%, 7.5 %, 7.5 percent and 7.5 per cent, without trailing zeros."""
    n = F.regexp_replace((share * 100).cast("decimal(12,4)").cast("string"), r"\.?0+$", "")
    return F.array(F.concat(n, F.lit("%")), F.concat(n, F.lit(" %")), F.concat(n, F.lit(" percent")), F.concat(n, F.lit(" per cent")))


def number_forms(n: Column) -> Column:
    """A whole number in digits and, up to twenty, as a word."""
    return F.array_distinct(F.array(n.cast("string"), F.coalesce(F.get(F.array(*map(F.lit, NUMBER_WORDS)), n.cast("int")), n.cast("string"))))


def has_money(text: Column) -> Column:
    """Whether a text states an amount: a currency before digits, two decimals, or three and more digits of cents."""
    return F.rlike(F.lower(text), F.lit(r"(gbp|£)\s?\d|\d[\d,]*\.\d{2}\b|\b\d{3,}\s?cents"))


def contains_any(text: Column, forms: Column) -> Column:
    """Whether a text has one of the forms, in any case, anywhere."""
    return F.exists(forms, lambda f: F.contains(F.lower(text), F.lower(f)))
