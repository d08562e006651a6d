"""Dates, rounding and the comparable form of result cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def like_column(df: DataFrame, name: str, value: str | Column) -> Column:
    """A literal in the type of a column, so that a comparison needs no cast
    on the column side and reaches the scan as a filter."""
    literal = F.lit(value) if isinstance(value, str) else value
    return literal.cast(df.schema[name].dataType)


def in_year(df: DataFrame, name: str, year: int) -> Column:
    """Half-open range over one calendar year."""
    first = like_column(df, name, f"{year:04d}-01-01")
    after = like_column(df, name, f"{year + 1:04d}-01-01")
    return (F.col(name) >= first) & (F.col(name) < after)


def shift_months(day: Column, months: int) -> Column:
    """Move a date by whole months. A day the target month lacks runs over
    into the next month (31 August less six months is 3 March, or 2 March in
    a leap year)."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def rounded_or_null(col: Column, places: int) -> Column:
    """Rounded value; null where the value is null or zero."""
    return F.round(F.nullif(col, F.lit(0.0)), places)


def rounded_or_zero(col: Column, places: int) -> Column:
    return F.coalesce(F.round(col, places), F.lit(0.0))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)

# Above this size neighbouring doubles are further apart than a cent.
_CENTS_LIMIT = float(2**46)


def _cents(value: Column) -> Column:
    return F.rint(value * 100).cast("bigint")


def round_cell(col: Column, dtype: T.DataType) -> Column:
    """Reals to two places (half a cent goes to the even cent), minus zero as
    zero; everything else unchanged."""
    if isinstance(dtype, T.DecimalType):
        return F.bround(col, 2)
    if not isinstance(dtype, _REAL):
        return col
    value = col.cast("double")
    return F.when(F.abs(value) < _CENTS_LIMIT, _cents(value) / F.lit(100.0)).otherwise(value)


def cell_text(col: Column, dtype: T.DataType) -> Column:
    """Text form of a cell in which equal values look alike: 5 and 5.0 agree,
    the number 5 and the text '5' do not, null stays null.

    Numbers are written in cents, which spares the formatting of doubles.
    """
    if isinstance(dtype, T.BooleanType):
        col, dtype = col.cast("bigint"), T.LongType()
    number = F.lit("n:")
    if isinstance(dtype, _WHOLE):
        value = col.cast("bigint")
        wide = (value.cast("decimal(20,0)") * 100).cast("string")
        small = F.abs(value.cast("double")) < 9.0e16
        return F.concat(number, F.when(small, (value * 100).cast("string")).otherwise(wide))
    if isinstance(dtype, _REAL):
        value = col.cast("double")
        cents = _cents(value).cast("string")
        wide = (value.cast("bigint").cast("decimal(20,0)") * 100).cast("string")
        whole = (value >= -float(2**63)) & (value < float(2**63)) & (F.rint(value) == value)
        text = (
            F.when(F.abs(value) < _CENTS_LIMIT, cents)
            .when(whole, wide)
            .otherwise(value.cast("string"))
        )
        return F.concat(number, text)
    if isinstance(dtype, T.DecimalType):
        # Exact: the digits of the rounded value, with the point moved out of the text.
        places = min(dtype.scale, 2)
        digits = F.translate(F.bround(col, 2).cast("string"), ".", "")
        return F.concat(number, F.regexp_replace(F.concat(digits, F.lit("0" * (2 - places))), "^(-?)0+(?=[0-9])", "$1"))
    return F.concat(F.lit("s:"), col.cast("string"))
