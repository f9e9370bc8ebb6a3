"""Numbers and prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with marks between its digits; a space parts only groups of three digits.
TOKEN = "[0-9]+(?:(?:[.,'’]|[   ](?=[0-9]{3}(?![0-9])))[0-9]+)*"
GROUPING = "[   '’]"


def read_number(token: Column) -> Column:
    """A number whose decimal mark is found out: of two kinds of marks the last; one mark before one or two digits; else none."""
    t = F.regexp_replace(token, GROUPING, "")
    both = t.contains(".") & t.contains(",")
    decimal = both | t.rlike("^[0-9]+[.,][0-9]{1,2}$")
    whole = F.regexp_replace(F.regexp_extract(t, "^(.*)[.,][0-9]*$", 1), "[.,]", "")
    text = F.when(decimal, F.concat(whole, F.lit("."), F.regexp_extract(t, "([0-9]*)$", 1))).otherwise(F.regexp_replace(t, "[.,]", ""))
    return text.try_cast("double")


def parse_price(raw: Column) -> Column:
    """The first number of a price text; null if there is none, or it is not positive."""
    value = read_number(F.regexp_extract(raw, f"({TOKEN})", 1))
    return F.when(value > 0, value)


def prices_in(text: Column) -> Column:
    """The distinct numbers of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), read_number))


def price_of(raw: Column, minor: Column, source: Column) -> Column:
    """A price as its source wrote it, in major units: ``minor`` digits are decimals. A bare integer of 1000 or more from captured
    data may be cents or not: it is unknown, not guessed."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    unclear = minor.isNull() & source.isin("render_json", "app_state") & t.rlike("^[0-9]+$") & (t.try_cast("long") >= 1000)
    return F.when(F.coalesce(minor, F.lit(0)) != 0, t.try_cast("long") / F.pow(F.lit(10.0), minor)).when(unclear, None).otherwise(parse_price(t))


def log_closeness(x: Column) -> Column:
    """How near a ratio is to 1: 0 at best; null where it is not positive."""
    return F.when(x > 0, -F.abs(F.ln(x)))
