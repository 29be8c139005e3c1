"""Hot keys: finding them, and spreading their rows over many tasks.

Adaptive execution already splits skewed partitions of a plain join. The helpers here cover
what it cannot see: a group that has to be cut before it is aggregated or windowed, and joins
whose output partitioning is reused. Results never depend on the keys found. A key that is
missed is only slower, so probing one scan and computing on a later one is safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from rillway.columns import has_map, quoted

HOT_LIMIT = 1024           # most hot keys ever fetched; one more is asked for to notice overflow
HOT_ROWS = 1_000_000       # rows of one key from which splitting pays
PART = "__part"
PARTS = "__parts"
ROW, COL, ROWS, COLS = "__row", "__col", "__rows", "__cols"     # of the grid of a key that is hot on both sides
GRID_ROWS = 10_000         # rows of one key from which a grid is considered: 10,000 by 10,000 are a task's worth of results
CELL_ROWS = 100_000_000    # results of one cell
GRID_COPIES = 32           # copies of a row on average, beyond which a grid finer than these limits is made coarser
BROADCAST_BYTES = 32 << 20  # of a side of numbers, up to which its rows need not be dealt to cells
PROBE_HITS = 1000          # sampled rows a key of min_rows rows is expected to have


@dataclass
class HotKeys:
    """The hottest keys of a frame with their (estimated) row counts, column __n.

    At most HOT_LIMIT keys are kept. A key that did not make the list has about 1/HOT_LIMIT of all
    rows at most (or min_rows at most), since every key on the list has at least as many.
    """

    keys: list[str]
    frame: DataFrame | None = None
    overflow: bool = False
    null_rows: int = 0

    def __bool__(self) -> bool:
        return self.frame is not None or self.null_rows > 0


def all_set(keys: list[str]) -> Column:
    condition = quoted(keys[0]).isNotNull()
    for k in keys[1:]:
        condition = condition & quoted(k).isNotNull()
    return condition


def find_hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS) -> HotKeys:
    """Keys with more than min_rows rows; rows with a null in the key count as one group.

    Runs one job that reads only the key columns and fetches HOT_LIMIT + 1 rows at most. Of large groups a sample is counted, in which a key of min_rows rows
    is expected PROBE_HITS times: enough to size its parts, and a thousandth of the shuffle. Only
    the counts come from the sample; whoever uses them still processes every row.
    """
    complete = all_set(keys)
    fraction = min(1.0, PROBE_HITS / min_rows)
    columns = [F.when(complete, quoted(k)).alias(k) for k in keys]
    counts = [(F.count(F.lit(1)) / F.lit(fraction)).cast("bigint").alias("__n")]
    probed = df.select(*columns)
    probed = probed.sample(fraction, seed=7) if fraction < 1 else probed
    counted = probed.groupBy(*[quoted(k) for k in keys]).agg(*counts).filter(F.col("__n") > min_rows)
    rows = counted.orderBy(F.desc("__n")).limit(HOT_LIMIT + 1).collect()
    null_rows = sum(r["__n"] for r in rows if r[keys[0]] is None)
    rows = [r for r in rows if r[keys[0]] is not None]
    frame = df.sparkSession.createDataFrame(rows[:HOT_LIMIT], counted.schema) if rows else None
    return HotKeys(keys, frame, len(rows) > HOT_LIMIT, null_rows)


def part_count(rows_per_part: int) -> Column:
    return F.ceil(F.col("__n") / F.lit(rows_per_part)).cast("long")


def spread(df: DataFrame, parts: Column) -> Column:
    """A part number in [0, parts) for each row of a hot group.

    It hashes the row and its input partition: copies of one row land in different parts, and a
    re-run task computes the same numbers again, whatever order its rows arrive in.
    """
    cols = [quoted(f.name) for f in df.schema if not has_map(f.dataType)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *cols), parts)


def _with_part_count(df: DataFrame, hot: HotKeys, rows_per_part: int) -> DataFrame:
    """Add __parts: over how many parts the rows of the key are spread, 1 unless it is hot."""
    one = F.lit(1).cast("long")
    if hot.frame is None:
        return df.withColumn(PARTS, one)
    # at most HOT_LIMIT small rows, see HotKeys
    sizes = F.broadcast(hot.frame.select(*[quoted(k) for k in hot.keys], part_count(rows_per_part).alias(PARTS)))
    return df.join(sizes, hot.keys, "left").withColumn(PARTS, F.coalesce(F.col(PARTS), one))


def spread_over_parts(df: DataFrame, hot: HotKeys, rows_per_part: int = HOT_ROWS) -> DataFrame:
    """Add __part, giving the rows of a hot key, and those without a key, different numbers."""
    null_parts = F.lit(max(1, -(-hot.null_rows // rows_per_part))).cast("long")
    parts = F.when(all_set(hot.keys), F.col(PARTS)).otherwise(null_parts)
    counted = _with_part_count(df, hot, rows_per_part)
    return counted.withColumn(PART, spread(df, parts)).drop(PARTS)


def repeat_for_parts(df: DataFrame, hot: HotKeys, rows_per_part: int = HOT_ROWS) -> DataFrame:
    """Add __part, repeating the rows of a hot key once per part, and __parts."""
    counted = _with_part_count(df, hot, rows_per_part)
    return counted.withColumn(PART, F.explode(F.sequence(F.lit(0).cast("long"), F.col(PARTS) - 1)))


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: HotKeys, rows_per_part: int = HOT_ROWS
) -> DataFrame:
    """Join on equally named keys, with the left rows of hot keys and of null keys spread over parts.

    The right rows of a hot key are repeated once per part. The keys must be the only names the
    two sides share. how is "inner" or "left".
    """
    if not hot:
        return left.join(right, keys, how)
    repeated = repeat_for_parts(right, hot, rows_per_part).drop(PARTS)
    return spread_over_parts(left, hot, rows_per_part).join(repeated, [*keys, PART], how).drop(PART)


def _grid(hot_left: HotKeys, hot_right: HotKeys, rows_per_part: int, cell_rows: int) -> DataFrame | None:
    """Over how many rows (parts of the left side) and columns (of the right side) each hot key is dealt: so many that no part
    has much more than rows_per_part rows and no cell of the grid much more than cell_rows results.

    Rows are repeated for each part of the other side, so limits far below HOT_ROWS and CELL_ROWS move more rows the larger the
    key. A grid that repeats them more than GRID_COPIES times is made coarser, as far as these two allow.
    """
    frames = [
        hot.frame.select(*[quoted(k) for k in hot.keys], F.col("__n").alias(n)) for hot, n in ((hot_left, "__l"), (hot_right, "__r"))
        if hot.frame is not None
    ]
    if not frames:
        return None
    sizes = frames[0] if len(frames) == 1 else frames[0].join(frames[1], hot_left.keys, "full")
    count = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(1)), F.lit(1)) if n in sizes.columns else F.lit(1)
    l, r = count("__l"), count("__r")

    def cut(part: int, results: int) -> tuple[Column, Column]:
        rows, cols = F.ceil(l / F.lit(part)), F.ceil(r / F.lit(part))
        finer = F.ceil(F.sqrt(F.greatest((l / rows) * (r / cols) / F.lit(results), F.lit(1.0))))
        # a side with few rows of the key is not cut below a row
        return F.least(rows * finer, l), F.least(cols * finer, r)

    rows, cols = cut(rows_per_part, cell_rows)
    least_rows, least_cols = cut(max(rows_per_part, HOT_ROWS), max(cell_rows, CELL_ROWS))
    coarser = F.greatest((l * cols + r * rows) / (F.lit(GRID_COPIES) * (l + r)), F.lit(1.0))
    rows, cols = F.greatest(F.ceil(rows / coarser), least_rows), F.greatest(F.ceil(cols / coarser), least_cols)
    return sizes.select(*[quoted(k) for k in hot_left.keys], rows.cast("bigint").alias(ROWS), cols.cast("bigint").alias(COLS))


def fits(df: DataFrame, most_bytes: int) -> bool:
    """Whether all columns are of fixed width and the rows, which are counted, take so many bytes at most as a broadcast table."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not all(isinstance(f.dataType, fixed) for f in df.schema):
        return False
    most = most_bytes // sum([24, *(16 if isinstance(f.dataType, T.DecimalType) else 8 for f in df.schema)])
    return most > 0 and df.limit(most + 1).count() <= most


def grid_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hit: str, hot_rows: int = GRID_ROWS,
    rows_per_part: int = HOT_ROWS, cell_rows: int = CELL_ROWS, broadcast_bytes: int = 0,
) -> DataFrame:
    """Join on equally named keys ("inner" or "left") with keys that may be hot on either side or on both.

    The left rows of such a key are dealt to the rows of a grid and repeated for its columns, the right rows to the columns and
    repeated for the rows: each pair meets in one cell, and each cell is a key of its own for the shuffle. Rows without a key
    are spread. hit names a column that is set in every right row. The keys must be the only names the two sides share.

    A right side of numbers that take broadcast_bytes at most goes to every task whole: then no row is repeated, and the left rows
    are dealt evenly, whatever their keys.
    """
    hot_left, hot_right = find_hot_keys(left, keys, hot_rows), find_hot_keys(right, keys, hot_rows)
    sizes = _grid(hot_left, hot_right, rows_per_part, cell_rows)
    if sizes is None and not hot_left.null_rows:
        return left.join(right, keys, how)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if broadcast_bytes and fits(right, broadcast_bytes):
        even = left.withColumn(PART, spread(left, F.lit(1 << 30))).repartition(tasks, quoted(PART)).drop(PART)
        return even.join(F.broadcast(right), keys, how)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def sized(df):
        if sizes is None:
            return df.withColumns({ROWS: one, COLS: one})
        # at most 2 * HOT_LIMIT small rows
        known = df.join(F.broadcast(sizes), keys, "left")
        return known.withColumns({ROWS: F.coalesce(F.col(ROWS), one), COLS: F.coalesce(F.col(COLS), one)})

    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    null_parts = F.lit(max(1, -(-hot_left.null_rows // rows_per_part))).cast("bigint")
    a = sized(left).withColumn(ROW, spread(left, F.when(all_set(keys), F.col(ROWS)).otherwise(null_parts))).withColumn(COL, every(COLS))
    b = sized(right.filter(all_set(keys))).withColumn(COL, spread(right, F.col(COLS))).withColumn(ROW, every(ROWS))
    cell, a, b = [*keys, ROW, COL], a.drop(ROWS), b.drop(ROWS, COLS)
    if sizes is not None:
        # dealt by cell into a stated number, whatever joins them: few small rows make many results, which sizes do not show
        a, b = (df.repartition(tasks, *[quoted(c) for c in cell]) for df in (a, b))
    joined = a.join(b, cell, how)
    # a copy whose column has no rows is dropped: a key with several columns has rows in another
    return joined.filter(quoted(hit).isNotNull() | (F.col(COLS) == 1)).drop(ROW, COL, COLS)


def cut_groups(df: DataFrame, keys: list[str], rows_per_part: int) -> DataFrame:
    """Add __part and __parts: the rows of each key are cut into parts of rows_per_part rows, the last of which may be shorter.

    The counts are exact, not those of a probe. Rows of a longer key are dealt to as many salts as it has parts, by their content,
    and counted by salt; a row's place is what the salts before hold and its place in its own. So no task orders more than a
    salt of a key, and equal input gives equal parts wherever it runs.
    """
    if rows_per_part < 1:
        raise ValueError("a part has one row at least")
    names = [quoted(k) for k in keys]
    one = F.lit(1).cast("long")
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    sizes = counted.filter(F.col("__n") > rows_per_part).select(*names, part_count(rows_per_part).alias(PARTS))
    sized = df.join(sizes, keys, "left").withColumn(PARTS, F.coalesce(F.col(PARTS), one))
    plain = [quoted(f.name) for f in df.schema if not has_map(f.dataType)]
    salted = sized.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.col(PARTS)))
    long = salted.filter(F.col(PARTS) > 1)
    by_salt = long.groupBy(*names, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*names).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_salt.select(*names, "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*names, "__salt").orderBy(*plain))
    placed = long.withColumn("__place", place).join(offsets, [*keys, "__salt"])
    part = F.floor((F.col("__before") + F.col("__place") - 1) / F.lit(rows_per_part)).cast("long")
    columns = [quoted(c) for c in df.columns]
    short = salted.filter(F.col(PARTS) == 1).select(*columns, F.lit(0).cast("long").alias(PART), PARTS)
    return short.unionByName(placed.select(*columns, part.alias(PART), PARTS))
