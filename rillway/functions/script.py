"""Script-style text, number and truth values of a column, for rules written against loosely typed rows."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from rillway.functions.coerce import is_fractional, is_integral, is_nested

SCRIPT_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
SCRIPT_HEX = r"^0[xX][0-9a-fA-F]{1,16}\z"
SCRIPT_BLANKS = " \t\n\r\u000b\f "


def _double_text(c: Column) -> Column:
    """Shortest decimal text without a trailing ".0"; exponents only from 1e21 up and below 1e-6."""
    size = F.abs(c)
    tidy = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), r"E([0-9])", "E+$1")
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(c == float("inf"), F.lit("Infinity"))
        .when(c == float("-inf"), F.lit("-Infinity"))
        .when(c == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-6), F.lower(exponent))
        .when(size < 1e14, tidy(c.try_cast("decimal(38,23)").cast("string")))
        .otherwise(tidy(c.try_cast("decimal(38,4)").cast("string")))
    )


def js_string(c: Column, t: T.DataType) -> Column:
    """Text as a script prints it: null is "null", whole doubles carry no fraction."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        text = _double_text(c.cast("double"))
    elif is_nested(t):
        text = F.to_json(c, {"ignoreNullFields": "false"})
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def js_number(c: Column, t: T.DataType) -> Column:
    """Number as a script reads it: blanks and null are 0, other text is NaN."""
    if isinstance(t, T.StringType):
        s = F.btrim(c, F.lit(SCRIPT_BLANKS))
        value = (
            F.when(s == "", F.lit(0.0))
            .when(s.rlike(SCRIPT_NUMBER), s.try_cast("double"))
            .when(s.rlike(SCRIPT_HEX), F.conv(F.substring(s, 3, 16), 16, 10).try_cast("double"))
            .when(s.isin("Infinity", "+Infinity"), F.lit(float("inf")))
            .when(s == "-Infinity", F.lit(float("-inf")))
            .otherwise(F.lit(float("nan")))
        )
    elif isinstance(t, T.BooleanType) or is_integral(t) or is_fractional(t):
        value = c.cast("double")
    else:
        value = F.lit(float("nan"))
    return F.when(c.isNull(), F.lit(0.0)).otherwise(value)


def truthy(c: Column, t: T.DataType) -> Column:
    """False for false, 0, NaN, the empty text and null; true for everything else."""
    if isinstance(t, T.BooleanType):
        value = c
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        value = (c != 0) & ~F.isnan(c)
    elif is_integral(t) or is_fractional(t):
        value = c != 0
    elif isinstance(t, T.StringType):
        value = c != ""
    elif isinstance(t, T.NullType):
        return F.lit(False)
    else:
        value = c.isNotNull()
    return F.coalesce(value, F.lit(False))
