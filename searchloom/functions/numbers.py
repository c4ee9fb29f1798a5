"""Text to number, rounding and ratio columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a decimal number, and the interface marks that mean zero.
NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
ZERO_PLACEHOLDERS = ("~", "-")


def squeeze_number(text: Column) -> Column:
    """Drop spaces, no-break spaces and thousands commas."""
    return F.translate(F.coalesce(text, F.lit("")), " \u00a0,\t\r\n", "")


def with_numbers(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add ``<name>_text`` (squeezed) and ``<name>_number`` (finite double or NULL) per entry.

    The steps are separate projections on purpose: each pattern is then evaluated once per row.
    """
    squeezed = df.withColumns({f"{n}_text": squeeze_number(t) for n, t in texts.items()})
    read = squeezed.withColumns(
        {
            f"{n}_number": F.when(F.col(f"{n}_text").rlike(NUMBER_PATTERN), F.col(f"{n}_text").try_cast("double"))
            for n in texts
        }
    )
    limit = F.lit(float("inf"))
    return read.withColumns(
        {f"{n}_number": F.when(F.abs(F.col(f"{n}_number")) < limit, F.col(f"{n}_number")) for n in texts}
    )


def number_issue(name: str, *, blank_allowed: bool) -> Column:
    """NULL for a usable non-negative number, else the reason it is refused."""
    text, value = F.col(f"{name}_text"), F.col(f"{name}_number")
    blank = F.lit(None).cast("string") if blank_allowed else F.lit("blank")
    return (
        F.when(text == "", blank).when(value.isNull(), F.lit("not_a_finite_number")).when(value < 0, F.lit("negative"))
    )


def non_negative(name: str) -> Column:
    value = F.col(f"{name}_number")
    return F.when(value >= 0, value)


def is_placeholder(text: Column) -> Column:
    return F.trim(text).isin(*ZERO_PLACEHOLDERS)


def clean(value: Column, digits: int = 10) -> Column:
    """Half-even rounding of reported values."""
    return F.bround(value, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.when(denominator != 0, numerator / denominator)


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))
