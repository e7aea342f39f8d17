"""Text and coercion expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a Unicode strip removes.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends; NULL stays NULL."""
    return F.btrim(text, F.lit(WHITESPACE))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def as_text(value: Column) -> Column:
    """Cast to string; a missing value stays missing, never the word 'None'."""
    return value.cast("string")


def to_number(value: Column) -> Column:
    """A double, or NULL where the text is not a number.

    Spark also reads Java's ``1d``/``1f`` suffixes and hex floats as numbers;
    those are refused. NaN and digits too large for a double count as missing.
    """
    text = value.cast("string")
    java_only = text.rlike(r"(?i)[0-9.][df]\s*$|x")
    number = F.when(~java_only, text.try_cast("double"))
    overflow = (F.abs(number) == float("inf")) & text.rlike("[0-9]")
    return F.when(~F.isnan(number) & ~overflow, number)


def is_missing(value: Column) -> Column:
    """NULL or NaN, for a numeric column."""
    return value.isNull() | F.isnan(value)
