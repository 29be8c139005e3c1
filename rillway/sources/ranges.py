"""Equi-depth ranges of a key of any ordered type, so that a table can be read in even parts by its key.

Keys are mapped to numbers in their order: text by the six bytes after the prefix that the smallest and the largest key
share, other types by their distance from the smallest. A quantile sketch of the numbers gives the cuts, one more pass counts
the rows between them exactly and finds the smallest key of each range, which becomes its bound. Ranges that are still too
large, such as texts that agree in those bytes, are cut again by what follows. What reaches the driver is a few rows per range.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from rillway.columns import quoted

IMAGE_BYTES = 6      # a double holds as many exactly
MOST_PARTS = 10_000
MOST_ROUNDS = 64


@dataclass(frozen=True)
class KeyRange:
    """Keys from low (included; None: from the first) up to high (not included; None: to the last), or the rows without a key."""

    low: object
    high: object
    rows: int
    null: bool = False

    def condition(self, key: Column) -> Column:
        if self.null:
            return key.isNull()
        low = key.isNotNull() if self.low is None else key >= F.lit(self.low)
        return low if self.high is None else low & (key < F.lit(self.high))

    def sql(self, key: str) -> str:
        """The condition as a predicate of a database. key is a name or an expression; text has to be compared there as it is
        here, by its bytes, so a column of another collation needs one in the expression."""
        if self.null:
            return f"{key} IS NULL"
        parts = [f"{key} IS NOT NULL"] if self.low is None else [f"{key} >= {sql_literal(self.low)}"]
        return " AND ".join(parts + ([] if self.high is None else [f"{key} < {sql_literal(self.high)}"]))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value) if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else f"'{value}'"


def _image(key: Column, kind: T.DataType, smallest, largest) -> Column:
    """A number that never falls as the key rises; a double, as the sketch works on."""
    if isinstance(kind, T.StringType):
        shared = len(os.path.commonprefix([smallest.encode(), largest.encode()]))
        digits = F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), shared + 1, IMAGE_BYTES)), 2 * IMAGE_BYTES, "0")
        return F.conv(digits, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(key.cast("timestamp")) - F.unix_micros(F.lit(smallest).cast("timestamp"))).cast("double")
    if isinstance(kind, T.NumericType):
        exact = "decimal(38,0)" if isinstance(kind, T.IntegralType) else kind.simpleString()
        return (key.cast(exact) - F.lit(smallest).cast(exact)).cast("double")
    raise ValueError(f"keys of type {kind.simpleString()} have no ranges")


def _cut(rows: DataFrame, key: Column, kind: T.DataType, smallest, largest, parts: int) -> list:
    """(number, smallest key, largest key, rows) of up to 2 * parts ranges, in order."""
    image = _image(key, kind, smallest, largest)
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx(image, shares, 20 * parts)).first()[0]))
    # a frequent number is a part of its own, apart from what lies between it and the next cut
    bounds = F.array(*[F.lit(c) for c in cuts])
    number = F.size(F.filter(bounds, lambda c: c <= image)) + F.size(F.filter(bounds, lambda c: c < image))
    found = rows.groupBy(number.alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
    return sorted(((r.part, r.low, r.high, r.n) for r in found.collect()), key=lambda r: r[0])


def key_ranges(df: DataFrame, key: str, parts: int = 32, slack: float = 1.5) -> list[KeyRange]:
    """Ranges that hold every row of df just once, each with about a parts-th of them: at most `slack` times that, unless one
    key alone has more. Rows without a key are a range of their own, if there are any. An empty table is one open range."""
    if not 1 <= parts <= MOST_PARTS:
        raise ValueError(f"parts must be from 1 to {MOST_PARTS}")
    kind, column = df.schema[key].dataType, quoted(key)
    keyed = df.select(column).filter(column.isNotNull())
    smallest, largest, total, every = df.agg(F.min(column), F.max(column), F.count(column), F.count(F.lit(1))).first()
    nulls = [KeyRange(None, None, every - total, True)] if every > total else []
    wanted = max(1, -(-total // parts))
    done, open_ = [], [(smallest, largest, total)] if total else []
    for _ in range(MOST_ROUNDS):
        if not open_:
            break
        again = []
        for low, high, n in open_:
            if n <= slack * wanted or low == high:
                done.append((low, n))
                continue
            inside = keyed if n == total else keyed.filter((column >= F.lit(low)) & (column <= F.lit(high)))
            pieces = _cut(inside, column, kind, low, high, min(MOST_PARTS, max(2, -(-n // wanted))))
            again += [(a, b, m) for _, a, b, m in pieces]
        open_ = again
    done = sorted([*done, *[(low, n) for low, _, n in open_]], key=lambda r: r[0])
    done = _merged(done, wanted)
    bounds = [None, *[low for low, _ in done[1:]], None]
    return [*(KeyRange(bounds[i], bounds[i + 1], n) for i, (_, n) in enumerate(done)), *nulls] or [KeyRange(None, None, 0)]


def _merged(ranges: list, wanted: int) -> list:
    """Neighbours joined while they stay within the wanted size, so that small leftovers of a cut are no ranges of their own."""
    out = []
    for low, n in ranges:
        if out and out[-1][1] + n <= wanted:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((low, n))
    return out
