"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

The words of each source, its documents in shuffled order, are cut into blocks of equal length. The mix is a schedule of
slots, one block each. Slot times are van der Corput points: with m bits there are 2^m of them, evenly spaced, and the
cumulative weights of the sources, counted in slots, cut that grid exactly. So each source gets just the slots its target
needs, and any stretch of the schedule holds the sources in nearly their shares. A source's slots are ranked by time and
joined to its blocks in their shuffled order; after the last block the first follows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import WORD, numbered, row_order, running_sum, saved, spread_join

#: Weights of the sources in code point order, and the limits of the mix.
WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
MOST_TIMES = 2
BLOCK_WORDS = 512
#: Stretches of shuffled documents or slots of one source that are summed or ranked on their own.
BUCKETS = 256
CHUNK = 1 << 16


def sizes_of(docs: DataFrame, extra=()) -> DataFrame:
    """row, doc_id, source, size (words) of each document, and the extra columns; a null text has no word."""
    return numbered(docs, "doc_id", "source", *extra, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with "rank", from 0 in the order of a column with distinct values, nulls last: ranges are counted apart, and the
    counts of the ranges, one row each, are summed up."""
    parts = saved(df.repartitionByRange(F.col(order).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col(order).asc_nulls_last())
    return parts.join(starts, "part").withColumn("rank", F.col("start") + F.row_number().over(inside) - 1).drop("part", "start")


def targets_of(sizes: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target, source_no: the total shared by weight, no source above `most_times` its size.

    Sources above their limit get it, the rest of the total is shared anew among the others, until none is above. Each
    round is one aggregate over the table of sources; only its sums come to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.col("rank") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (no + 1).cast("int"))
    table = saved(ranked(sources, "source").withColumn("weight", weight).withColumn("cap", most_times * F.col("source_size")), "mix-sources")
    whole = table.agg(F.sum("source_size").alias("n")).first().n or 0
    total, rate = whole * total_percent / 100, 0.0
    free = F.lit(True)
    while True:
        row = table.agg(F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("w"), F.sum(F.when(free, 0).otherwise(F.col("cap"))).alias("c")).first()
        if not row.w:
            break
        new = (total - row.c) / row.w
        if new <= rate:
            break
        rate = new
        free = F.col("weight") * F.lit(rate) <= F.col("cap")
    target = F.when(free, F.col("weight") * F.lit(rate)).otherwise(F.col("cap")).cast("double")
    return saved(table.select("source", "source_size", target.alias("target"), F.col("rank").alias("source_no")), "mix-targets")


def reversed_bits(n: Column, bits: int) -> Column:
    """The van der Corput point of n, times 2^bits: the bits of n from last to first."""
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, time, rank, block, words: the slots of the mix; time orders them, rank counts a source's own.

    A pass over a source has ceil(size / block_words) blocks, the last one short; the last slot of all takes what is
    missing to the target (rounded down to whole words).
    """
    blocks = lambda n: F.ceil(n / F.lit(block_words)).cast("long")
    take = F.floor("target").cast("long")
    first = F.least(take, F.col("source_size"))
    # More than one pass: whole passes first, then what is left.
    passes = F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(0).cast("long")
    left = take - passes * F.col("source_size")
    need = targets.where("source_size > 0").select(
        "source_no", "source_size", blocks(F.col("source_size")).alias("blocks"), passes.alias("passes"), left.alias("left"),
        (passes * blocks(F.col("source_size")) + blocks(left)).alias("slots"),
    ).where("slots > 0")
    need = saved(need.withColumn("all", F.lit(0)).withColumn("no_bucket", F.floor(F.col("source_no") / CHUNK)), "mix-need")
    starts = running_sum(need, "all", ["source_no"], "no_bucket", "slots", "first_cell")
    count = need.agg(F.sum("slots").alias("n")).first().n or 0
    bits = max(1, math.ceil(math.log2(max(count, 2))))
    chunks = starts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK)))).repartition("source_no", "chunk")
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1
    cells = chunks.withColumn("cell", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    timed = cells.withColumn("time", reversed_bits(F.col("first_cell") + F.col("cell"), bits)).withColumn("one", F.lit(1))
    step = max(1, (1 << bits) // BUCKETS)
    order = running_sum(timed.withColumn("stretch", F.floor(F.col("time") / step)), "source_no", ["time"], "stretch", "one", "rank")
    block = F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    words = F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("passes"), length).otherwise(F.least(length, F.col("left") - block * block_words))
    return order.select("source_no", "time", "rank", block.alias("block"), words.alias("words"))


def with_targets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The documents with their source's columns; a hot source's documents are dealt over several tasks."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")
    return spread_join(sizes.select("*", key), targets.select(key, "source_no", "source_size", "target"), ["key"], F.col("row")).drop("key")


def pieces_of(sizes: DataFrame, targets: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents cut at block limits: row, source_no, at (first word in its source's shuffled order), size, block, low
    and high (words within the block). Documents without words have no piece."""
    docs = with_targets(sizes.where("size > 0"), targets)
    mix = F.xxhash64(F.lit(seed), "doc_id", "size")
    shuffled = docs.select("row", "source_no", "size", mix.alias("mix")).withColumn("stretch", F.shiftrightunsigned("mix", 56))
    shuffled = shuffled.withColumn("order", F.shiftrightunsigned("mix", 1))
    placed = running_sum(shuffled, "source_no", ["order", "row"], "stretch", "size", "at")
    end = F.col("at") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))))
    start = F.col("block") * block_words
    return cut.select(
        "row", "source_no", "at", "size", "block", (F.greatest(F.col("at"), start) - start).alias("low"),
        (F.least(end, start + block_words) - start).alias("high"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """mix_rows without further columns."""
    return mix_rows(docs, (), **options)


def mix_rows(docs: DataFrame, extra, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, most_times: int = MOST_TIMES, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, copies and the extra columns for each document (doc_id, source, text).

    copies: how often the mix takes the document's first word, for those who take documents whole. Null sources come
    last and are one source; documents without words are taken 0 times. Repeated rows count one by one.
    """
    sizes = saved(sizes_of(docs, extra), "mix-sizes")
    targets = targets_of(sizes, weights, total_percent, most_times)
    slots = schedule(targets, block_words).select("source_no", "block", "words")
    pieces = pieces_of(sizes, targets, seed, block_words)
    got = pieces.join(slots, ["source_no", "block"]).select(
        "row",
        F.greatest(F.lit(0), F.least("high", "words") - F.col("low")).cast("long").alias("taken"),
        F.when((F.col("at") == F.col("block") * block_words + F.col("low")) & (F.col("words") > F.col("low")), 1).otherwise(0).alias("first"),
    )
    taken = got.groupBy("row").agg(F.sum("taken").alias("taken"), F.sum("first").alias("copies"))
    return with_targets(sizes, targets).join(taken, "row", "left").select(
        "row", "doc_id", *extra, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes its first word; all columns are returned.

    Rows are found again by id, source and text, of which repeated rows share the copies of all of them,
    in the order of a hash of all their columns.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select("doc_id", "source", "text", id_key.alias("id_key"), source_key.alias("source_key"), text_hash.alias("text_hash"))
    copies = mix_rows(rows, ["id_key", "source_key", "text_hash"], **options).groupBy("id_key", "source_key", "text_hash")
    copies = copies.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    keyed = docs.select(F.struct("*").alias("row"), id_key.alias("id_key"), source_key.alias("source_key"), text_hash.alias("text_hash"))
    found = keyed.join(copies, ["id_key", "source_key", "text_hash"])
    nth = Window.partitionBy("id_key", "source_key", "text_hash").orderBy(row_order(docs, "row"))
    each = F.floor(F.col("copies") / F.col("rows")) + (F.row_number().over(nth) <= F.col("copies") % F.col("rows")).cast("long")
    return found.withColumn("each", each).where("each > 0").select("row", F.explode(F.sequence(F.lit(1), "each"))).select("row.*")
