"""Column expressions over raw text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fixed_values import INTEGER_PATTERN, NUMBER_PATTERN, STRIP_CHARACTERS

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
_INTEGER_STARTS = list("0123456789+-")
_NUMBER_STARTS = _INTEGER_STARTS + list(".iInN")

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(cell: Column) -> Column:
    """Remove Unicode whitespace from both ends; null stays null."""
    return F.btrim(cell, F.lit(STRIP_CHARACTERS))


def normalise(cell: Column) -> Column:
    """Stripped text, with null as the empty string."""
    return F.coalesce(strip(cell), F.lit(""))


def is_integer(text: Column) -> Column:
    """Whole-number text. The first character rules out most words before the regex runs."""
    return F.left(text, F.lit(1)).isin(*_INTEGER_STARTS) & text.rlike(INTEGER_PATTERN)


def is_number(text: Column) -> Column:
    return F.left(text, F.lit(1)).isin(*_NUMBER_STARTS) & text.rlike(NUMBER_PATTERN)


def to_long(text: Column) -> Column:
    """Whole number, or null when the text is none or exceeds 64 bits."""
    return F.when(is_integer(text), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Floating-point value, or null when the text is not a number."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    signed_nan = F.lower(plain).isin("+nan", "-nan")
    return F.when(is_number(text), F.when(signed_nan, F.lit(float("nan"))).otherwise(plain.try_cast("double")))


def as_text(name: str, dtype: T.DataType) -> Column:
    """Any column as normalised cell text."""
    return normalise(column(name)) if isinstance(dtype, T.StringType) else stripped_text(name, dtype)


def stripped(df: DataFrame) -> DataFrame:
    """``df`` with its text cells normalised, for expressions that use them many times."""
    return df.select([normalise(column(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else column(f.name) for f in df.schema.fields])


def stripped_text(name: str, dtype: T.DataType) -> Column:
    """``as_text`` of a column of a ``stripped`` table."""
    cell = column(name)
    if isinstance(dtype, T.StringType):
        return cell
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.to_json(cell), F.lit(""))
    return F.coalesce(cell.cast("string"), F.lit(""))


def normalise_row(schema: T.StructType) -> list[Column]:
    """Every column of a table as normalised text, in one projection."""
    return [as_text(f.name, f.dataType).alias(f.name) for f in schema.fields]
