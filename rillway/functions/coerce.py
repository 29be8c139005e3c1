"""Lossy, never-null coercions to long, float and string.

Each takes the column and its Spark type, since a text "12.5" and a double 12.5 follow
different rules. All three are plain expressions and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807
LONG_MIN = -9223372036854775808

# Accepted number texts. \z instead of $, which would let a final newline through.
INTEGER_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity)|(?i:nan))\z"

COERCED_TYPES = {"long": T.LongType(), "float": T.DoubleType(), "string": T.StringType()}


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def to_long(c: Column, t: T.DataType) -> Column:
    """Whole-number text is parsed and clamped to 64 bits, fractions are cut, anything else is 0."""
    if isinstance(t, T.StringType):
        limit = F.when(c.startswith("-"), F.lit(LONG_MIN)).otherwise(F.lit(LONG_MAX))
        parsed = F.coalesce(c.try_cast("bigint"), limit)
        return F.when(c.rlike(INTEGER_TEXT), parsed).otherwise(F.lit(0).cast("bigint"))
    if is_integral(t) or is_fractional(t):
        return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def to_float(c: Column, t: T.DataType) -> Column:
    """Number text is parsed (overflow gives an infinity), anything that is no number is 0.0."""
    if isinstance(t, T.StringType):
        return F.when(c.rlike(FLOAT_TEXT), F.coalesce(c.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    if is_integral(t) or is_fractional(t):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return F.lit(0.0)


def six_decimals(c: Column) -> Column:
    """A double as text with six decimals; the infinities and NaN keep their short names."""
    d = c.cast("double")
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(d == float("inf"), F.lit("+Inf"))
        .when(d == float("-inf"), F.lit("-Inf"))
        .otherwise(F.format_string("%.6f", d))
    )


def plain_text(c: Column, t: T.DataType) -> Column:
    """Text of one value, null stays null."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), six_decimals(c))
    if is_nested(t):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def to_text(c: Column, t: T.DataType) -> Column:
    """Like plain_text, but null becomes the empty text."""
    return F.coalesce(plain_text(c, t), F.lit(""))


_COERCIONS = {"long": to_long, "float": to_float, "string": to_text}


def coerce_column(c: Column, t: T.DataType, *steps: str) -> Column:
    """Apply coercions one after the other, e.g. coerce_column(c, t, "long", "string")."""
    for step in steps:
        if step not in _COERCIONS:
            raise ValueError(f"unknown coercion type {step!r}, use long, float or string")
        c, t = _COERCIONS[step](c, t), COERCED_TYPES[step]
    return c
