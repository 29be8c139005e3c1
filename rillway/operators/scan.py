"""Segmented scan: what the last decisive change before each row of a key said, with hot keys cut by position.

The positions of a key are cut into blocks of 2^bits, these into blocks of 2^bits blocks, and so on. A block is reduced to the
state it leaves behind (a value, or null for "unchanged"), and such states compose: the last one that is set wins. Going up,
blocks are reduced to their parents' states; going down, each block is told the state in which it begins; inside the smallest
blocks the rows are gone through in order. All tasks are dealt by key and block, so no key needs to be known as hot, and rows
without a key are cut like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.columns import quoted

BITS = 16       # positions of a block: at most 65,536 rows of a key in one window
LEVELS = 2      # from 2^32 positions up, the blocks of a key are one window


def last_before(df: DataFrame, keys: list[str], pos: str, value: str, out: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Add out: the last value that is not null before the row, by the whole number pos, among the rows of its key; null keys
    are one key. Rows of one key and position should be alike in value."""
    blocks = [f"__block{i}" for i in range(1, levels + 1)]
    names = [f"__key{i}" for i in range(len(keys))]
    cut = df.withColumns({b: F.shiftright(quoted(pos).cast("bigint"), bits * i) for i, b in enumerate(blocks, 1)})
    decisive = F.when(quoted(value).isNotNull(), quoted(pos))
    summary = cut.select(*[quoted(k).alias(n) for k, n in zip(keys, names)], *blocks, quoted(value).alias("__state"), decisive.alias("__at"))
    ends = []
    for i in range(levels):
        summary = summary.groupBy(*names, *blocks[i:]).agg(F.max_by("__state", "__at").alias("__state"), F.max("__at").alias("__at"))
        ends.append(summary)
    begins = _carried(ends[-1], names, blocks[-1])
    for i in range(levels - 2, -1, -1):
        inside = _carried(ends[i], [*names, *blocks[i + 1:]], blocks[i])
        begins = _with_begin(inside, begins, names, names, blocks[i + 1:], "__begin").select(*names, *blocks[i:], "__begin")
    window = Window.partitionBy(*[quoted(k) for k in keys], *blocks).orderBy(quoted(pos))
    rows = cut.withColumn(out, F.last(quoted(value), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)))
    return _with_begin(rows, begins, keys, names, blocks, out).select(*[quoted(c) for c in df.columns], out)


def _carried(ends: DataFrame, group: list[str], block: str) -> DataFrame:
    """The state in which each block of a group begins, as far as the blocks before it in the group tell."""
    window = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("__begin", F.last("__state", ignorenulls=True).over(window)).drop("__state", "__at")


def _with_begin(rows: DataFrame, begins: DataFrame, keys: list[str], names: list[str], blocks: list[str], out: str) -> DataFrame:
    """out completed by the state in which the row's block begins. Null keys meet null keys."""
    right = begins.select(*[F.col(n).alias(f"__r{n}") for n in (*names, *blocks)], F.col("__begin").alias("__carried"))
    same = F.lit(True)
    for k, n in zip([*keys, *blocks], [*names, *blocks]):
        same = same & quoted(k).eqNullSafe(F.col(f"__r{n}"))
    return rows.join(right, same, "left").withColumn(out, F.coalesce(F.col(out), F.col("__carried")))
