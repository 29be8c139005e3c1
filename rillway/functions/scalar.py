"""The script helper functions as column functions.

Null in gives null out unless js=True, where a null text argument reads as the word "null"
the way a script would print it. No Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from rillway.functions.coerce import is_fractional, is_integral

# Characters trimmed by default (space, tab, line feed, carriage return, null, vertical tab)
TRIM_CHARS = " \t\n\r\u0000\u000b"

# Accepted date formats and their Spark patterns
DATE_FORMATS = {"Y-m-d": "yyyy-MM-dd", "Y-m-d H:i:s": "yyyy-MM-dd HH:mm:ss"}
DATE_OR_TIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?\z"

# doubles from here on have no fraction and may not fit a long
_WHOLE_FROM = float(2**52)


def _text(c: Column, js: bool) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null")) if js else c


def ifnull(v: Column, default: Column, text: bool = True) -> Column:
    """default where v is null, or the empty text when v is a text column."""
    missing = v.isNull() | (v == "") if text else v.isNull()
    return F.when(missing, default).otherwise(v)


def pad(s: Column, fill: str, n: int, side: str = "l", strict: bool = False, js: bool = False) -> Column:
    """Add fill once per missing character; a longer fill overshoots n. Long texts come back as they
    are, or as their length in text form with strict=True."""
    s = _text(s, js)
    missing = F.lit(n) - F.char_length(s)
    if side == "r":
        padded = F.concat(s, F.repeat(F.lit(fill), missing))
    else:
        padded = F.concat(F.repeat(F.lit(fill[::-1]), missing), s)
    full = F.char_length(s).cast("string") if strict else s
    return F.when(missing > 0, padded).when(missing <= 0, full)


def trim(s: Column, chars: str = TRIM_CHARS, side: str = "b") -> Column:
    strip = {"l": F.ltrim, "r": F.rtrim}.get(side, F.btrim)
    return strip(s, F.lit(chars))


def startwith(s: Column, prefix: Column, js: bool = False) -> Column:
    return F.startswith(_text(s, js), _text(prefix, js))


def endwith(s: Column, suffix: Column, js: bool = False) -> Column:
    return F.endswith(_text(s, js), _text(suffix, js))


def strtoupper(s: Column, js: bool = False) -> Column:
    return F.upper(_text(s, js))


def strtolower(s: Column, js: bool = False) -> Column:
    return F.lower(_text(s, js))


def strrev(s: Column, js: bool = False) -> Column:
    return F.reverse(_text(s, js))


def strtotime(s: Column) -> Column:
    """Epoch seconds of a 10-character date or a 19-character date and time, else null."""
    return F.when(s.rlike(DATE_OR_TIME_TEXT), F.unix_timestamp(s.try_cast("timestamp")))


def date(fmt: str, seconds: Column) -> Column:
    """Epoch seconds as text in one of two formats, null for any other format."""
    if fmt not in DATE_FORMATS:
        return F.lit(None).cast("string")
    return F.from_unixtime(seconds, DATE_FORMATS[fmt])


def now() -> Column:
    """Epoch seconds, one value per query or micro-batch."""
    return F.unix_timestamp()


def _whole(x: Column, f) -> Column:
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= _WHOLE_FROM), d).otherwise(_signed(f(d).cast("double"), d))


def _signed(result: Column, d: Column) -> Column:
    """A zero keeps the sign of the number it came from."""
    return F.when(result == 0, d * 0.0).otherwise(result)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def round(x: Column) -> Column:
    """Halves go away from zero."""
    d = x.cast("double")
    return _signed(F.round(d), d)


def rand(*bounds: int, seed: int | None = None) -> Column:
    """rand(max) is in [0, max); rand(min, max) is min plus a value in [0, max)."""
    low, span = {0: (0, 2**63 - 1), 1: (0, *bounds), 2: bounds}[len(bounds)]
    return F.floor(F.rand(seed) * F.lit(span)) + F.lit(low).cast("bigint")


def abs(x: Column) -> Column:
    return F.abs(x.cast("double"))


def _number(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def max_args(*cols: Column) -> Column:
    """Greatest of two or more numeric columns, nulls and NaN ignored. Pass only numeric columns
    (see numeric_names); fewer than two arguments give null."""
    return F.greatest(*[_number(c) for c in cols]) if len(cols) > 1 else F.lit(None).cast("double")


def min_args(*cols: Column) -> Column:
    return F.least(*[_number(c) for c in cols]) if len(cols) > 1 else F.lit(None).cast("double")


def _numbers(array: Column) -> Column:
    doubles = F.transform(array, lambda x: x.cast("double"))
    return F.filter(doubles, lambda x: x.isNotNull() & ~F.isnan(x))


def max_array(array: Column) -> Column:
    return F.array_max(_numbers(array))


def min_array(array: Column) -> Column:
    return F.array_min(_numbers(array))


def is_number(c: Column, t: T.DataType) -> Column:
    """True for a non-null value of a numeric type; numeric text is no number."""
    if is_integral(t) or is_fractional(t):
        return c.isNotNull()
    return F.lit(False)


def is_number_at(json: Column, path: str) -> Column:
    """is_number for one field of a JSON text, whose type may differ from row to row."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    return F.coalesce(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.lit(False))


def numeric_names(schema: T.StructType, names: list[str]) -> list[str]:
    """Those of the named columns that hold numbers."""
    return [n for n in names if is_integral(schema[n].dataType) or is_fractional(schema[n].dataType)]
