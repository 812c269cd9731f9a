"""Text to number and text to instant, with the exact acceptance rules of the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewarden.functions.text import let

# The shapes the feeds use.
NUMBER_SHAPE = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity)$"
CAPTURED_PRICE = r"^(?:S/\s*)?(\d+(?:[.,]\d{1,4})?)$"
INSTANT_SHAPE = (
    r"^\d{4}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])"
    r"(?:[ T](?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d|24:00:00)(?:\.\d+)?)?$"
)
SOURCE_OFFSET_SECONDS = 5 * 3600  # the feeds print local time at UTC-05:00


def clean(col: Column) -> Column:
    """Trim and drop carriage returns; null stays an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), "\r", ""), F.lit(" \t\n\u00a0\ufeff"))


def parse_price(col: Column) -> Column:
    """Decimal point or comma. Empty text is 0 and unreadable text NaN, so neither is ever > 0."""

    def number(text: Column) -> Column:
        return (
            F.when(text == "", F.lit(0.0))
            .when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))
            .otherwise(F.lit(float("nan")))
        )

    return let(F.trim(F.regexp_replace(col, "^([^,]*),", "$1.")), number)


def parse_captured_price(col: Column) -> Column:
    """Optional currency sign, digits, up to four decimals; anything else is NaN."""
    digits = F.regexp_extract(F.trim(col), CAPTURED_PRICE, 1)
    return F.when(digits != "", F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")).otherwise(
        F.lit(float("nan"))
    )


def parse_instant(col: Column) -> Column:
    """Local date with optional time at a fixed offset; unreadable text is null.

    Days 29 to 31 that the month lacks roll into the next month, as the source system reads them.
    """

    def instant(text: Column) -> Column:
        def number(start: int, width: int) -> Column:
            return F.substring(text, start, width).cast("int")

        def clock(start: int) -> Column:
            return F.when(F.length(text) > 10, number(start, 2)).otherwise(F.lit(0))

        # The shape fixes every position, so fields are cut out by place. It is tested first: a cast that
        # fails costs far more than the test.
        first = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 6, 2), F.lit("-01"))
        month_start = first.cast("date")
        days = F.unix_date(month_start).cast("long") + number(9, 2) - 1
        seconds = days * 86400 + clock(12) * 3600 + clock(15) * 60 + clock(18) + SOURCE_OFFSET_SECONDS
        return F.when(text.rlike(INSTANT_SHAPE), F.timestamp_seconds(seconds))

    return let(clean(col), instant)


def positive(col: Column) -> Column:
    """Finite and above zero. NaN sorts above every number, so the test has to name it."""
    return F.coalesce((col > 0) & ~F.isnan(col) & (col != float("inf")), F.lit(False))
