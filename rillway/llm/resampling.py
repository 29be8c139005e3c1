"""Importance resampling towards a target: documents are drawn in proportion to how much likelier the target makes their words.

Words and runs of words are hashed into buckets. The counts of both tables give one gain per bucket, an array; a
document's weight is the mean gain of its features, looked up in the array. A fixed random term per document makes the highest scores a
draw without replacement. The scores are written once; the cutoff is found by bisection, in jobs that count exactly,
first over scores, then over the ids that share the last score. The drawn rows are range-partitioned for their ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import numbered, running_sum, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words, all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: The id of rows without one, in ties: they come last.
NO_ID = (1 << 63) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def runs_of(words: Column, width: int) -> list[Column]:
    """For each length up to width, the array of all runs of so many words."""
    runs = [words]
    for n in range(2, width + 1):
        many = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], 1, many), F.slice(words, n, many), lambda a, b: F.concat(a, F.lit(" "), b)))
    return runs


def bucketed(table: DataFrame, columns: list, text: str, width: int, buckets: int) -> DataFrame:
    """The columns with n_words and the buckets of all features, repeats included."""
    kind = "smallint" if buckets <= 1 << 15 else "int"
    words = table.select(*columns, words_of(F.col(text)).alias("words"))
    hashed = [F.transform(run, lambda f: (F.crc32(f) % buckets).cast(kind)) for run in runs_of(F.col("words"), width)]
    return words.select(*[c for c in words.columns if c != "words"], F.size("words").alias("n_words"), F.concat(*hashed).alias("features"))


def bucket_counts(features: DataFrame) -> dict[int, int]:
    """Features per bucket; the number of buckets bounds what reaches the driver."""
    return dict(features.select(F.explode("features").alias("bucket")).groupBy("bucket").count().collect())


def gains(documents: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """1000 times the logarithm of target share over corpus share per bucket, each count raised by one, rounded down."""
    s, t = sum(documents.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((documents.get(b, 0) + 1) * t))) for b in range(buckets)]


def cutoff(rows: DataFrame, keys: list[str], wanted: int, sections: int = 16) -> list[int]:
    """The values of `keys` (whole numbers, ascending) of the last of the `wanted` smallest rows. The list ends at the key from
    which on all rows that share it are wanted. Each job counts the rows up to `sections` - 1 bounds and fetches one row."""
    found = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        below = 0
        upto = None  # rows up to high, once counted
        while low < high:
            bounds = sorted({low + (high - low) * i // sections for i in range(sections)})
            counts = rows.agg(*[F.count_if(F.col(key) <= F.lit(b)).alias(f"n{i}") for i, b in enumerate(bounds)]).first()
            for bound, n in zip(bounds, counts):
                if n >= wanted:
                    high, upto = bound, n
                    break
                low, below = bound + 1, n
        if upto is None:
            upto = rows.where(F.col(key) <= F.lit(high)).count()
        found.append(high)
        if upto == wanted:
            return found
        rows, wanted = rows.where(F.col(key) == F.lit(high)), wanted - below
    return found


def up_to(keys: list[str], last: list[int]) -> Column:
    """Rows whose keys are not above `last` in lexicographic order."""
    at_most = F.col(keys[len(last) - 1]) <= F.lit(last[-1])
    for key, value in reversed(list(zip(keys, last[:-1]))):
        at_most = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & at_most)
    return at_most


def ranks(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """row, the last key, and its rank 1, 2, 3... by the keys. Range partitions are ranked apart, their sizes summed give each its start."""
    parts = saved(rows.select(*keys).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "resample-parts")
    one = parts.withColumns({"all": F.lit(0), "one": F.lit(1)})
    return running_sum(one, "all", keys, "part", "one", out).select("row", (F.col(out) + 1).cast("long").alias(out))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, width: int = RUN, seed: int = SEED,
    extra: tuple = (), sections: int = 16,
) -> DataFrame:
    """row, doc_id, n_features, weight, score, rank and the extra columns for each row of docs (doc_id integer, text; others ignored).

    target needs a text. Null texts count as empty; a text without features has weight 0. percent of the documents of
    least_words or more are drawn, rounded down; rank is null for the others. Equal scores go to the smaller id, null ids last (their
    random term is that of an empty id), repeated rows in their stored order. A target or corpus without rows is no error.
    """
    features = saved(bucketed(numbered(docs, "doc_id", "text", *extra), ["row", "doc_id", *extra], "text", width, buckets), "resample-features")
    gain = gains(bucket_counts(features), bucket_counts(bucketed(target, [], "text", width, buckets)), buckets)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int")))
    scored = features.select("row", "doc_id", *extra, "n_words", F.size("features").cast("long").alias("n_features"), total.alias("total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    scored = scored.withColumn("weight", F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)"))
    random = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = scored.select("row", "doc_id", *extra, "n_words", "n_features", "weight", (F.col("weight") + random).alias("score"))
    scored = saved(scored, "resample-scores")
    keys = ["falling", "tie", "row"]
    eligible = scored.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("falling"), F.coalesce("doc_id", F.lit(NO_ID)).alias("tie"), "row")
    wanted = percent * eligible.count() // 100
    drawn = eligible.where(up_to(keys, cutoff(eligible, keys, wanted, sections))) if wanted else eligible.limit(0)
    return scored.join(ranks(drawn, keys, "rank"), "row", "left").select("row", "doc_id", *extra, "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs with all their columns, as resample() draws them."""
    packed = saved(docs.select("doc_id", "text", F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at")), "resample-docs")
    drawn = resample(packed.select("doc_id", "text", "at"), target, extra=("at",), **options).where("rank is not null").select("at")
    return packed.join(drawn, "at", "left_semi").select("doc.*")
