"""Quality rules: counts within each text, and lines that many documents of a host share.

Lines are normalised (lower case, digits to 0, white space to one space) and hashed. Per host, the source of a document, the
distinct documents that hold a line are counted; copies of one document are not distinct documents, so documents of the same
words (case and white space ignored) count once. Lines above the limits are removed, and a document that loses too large
a part of its words is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.columns import quoted
from rillway.llm.common import numbered, saved, spread_join

#: The characters counted as symbols, and white space.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    most_repeat_percent: int = 20
    window: int = 5
    #: A line is above the limits if at least this many distinct documents of its host hold it, and this share of them.
    line_documents: int = 10
    line_share: float = 0.05
    #: A document is depleted if less than this share of its words is left.
    least_left: float = 0.3


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, list(known)


def repeated_words(ids: np.ndarray, distinct: int, width: int) -> int:
    """Words in windows of `width` words that are found at least twice. Windows are named by ranks, exactly."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    names, have = ids, 1
    while have < width:
        step = min(have, width - have)
        pairs = names[: len(ids) - have - step + 1] * (int(names.max()) + 1) + names[step : len(ids) - have + 1]
        names, have = np.unique(pairs, return_inverse=True)[1], have + step
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[again] += 1
    np.subtract.at(edge, again + width, 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


DIGITS = bytes.maketrans(b"123456789", b"000000000")


def signature(text: str) -> int:
    """A hash of the whole text, case and white space ignored: equal in copies only."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().encode().split())) - (1 << 63)


def measure(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = text.encode().split()
    ids, names = word_ids(words)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    hashes, counts = [], []
    for line in lines:
        parts = line.lower().encode().translate(DIGITS).split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63))
        counts.append(len(parts))
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids, len(names), rules.window), signature(text), hashes, counts,
    )


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, signature long, lines array<long>, line_words array<int>"


def id_key():
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("id_key")


def host():
    return F.coalesce("source", F.lit(""))


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def measured(docs: DataFrame, rules: Rules) -> DataFrame:
    """row, doc_id, source, text_hash and MEASURES of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            found = pd.DataFrame([measure(t, rules) for t in batch.pop("text")], columns=names, index=batch.index)
            yield pd.concat([batch, found], axis=1)

    kinds = dict(docs.select("doc_id").dtypes)
    return numbered(docs, "doc_id", id_key(), host().alias("source"), text_hash(), "text").mapInPandas(
        run, f"doc_id {kinds['doc_id']}, id_key string, source string, text_hash long, row long, {MEASURES}"
    )


def frequent_lines(texts: DataFrame, rules: Rules) -> DataFrame:
    """source, line, documents: the lines above the limits of their host. Every grouping combines before it shuffles."""
    lines = texts.select("source", "signature", F.explode(F.array_distinct("lines")).alias("line"))
    counts = lines.groupBy("source", "line", "signature").agg(F.lit(1).alias("one")).groupBy("source", "line").agg(F.count("one").alias("documents"))
    above = counts.where(F.col("documents") >= rules.line_documents)
    hosts = texts.where("n_words > 0").groupBy("source", "signature").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("one").alias("of_host"))
    return spread_join(above, hosts, ["source"], F.col("line")).where(F.col("documents") >= rules.line_share * F.col("of_host")).drop("of_host")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """row, doc_id, the base counts, n_removed_words, base_failed, depleted and kept of each document (doc_id, source, text).

    A null text has no words; a null source is a host of its own, "". Repeated rows are judged one by one.
    """
    texts = saved(measured(docs, rules), "quality-texts")
    above = saved(frequent_lines(texts, rules).select("source", "line"), "quality-lines")
    pairs = texts.select("row", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "source", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = spread_join(pairs, above, ["source", "line"], F.col("row")).groupBy("row").agg(F.sum("words").alias("gone"))
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    depleted = (gone > 0) & (F.col("n_words") - gone < rules.least_left * F.col("n_words"))
    return texts.join(removed, "row", "left").select(
        "row", "doc_id", "id_key", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_removed_words"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the lines above the limits of their host. All columns are returned, a null text stays null."""
    texts = saved(measured(docs.select("doc_id", "source", "text"), rules), "quality-texts")
    above = saved(frequent_lines(texts, rules).select("source", "line"), "quality-lines")
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "quality-docs")
    split = rows.select("_row", host().alias("source"), F.posexplode(F.split("text", "\n")).alias("at", "text"))

    def hashed(batches):
        for batch in batches:
            parts = [t.lower().encode().translate(DIGITS).split() for t in batch["text"]]
            batch["line"] = [xxhash.xxh64_intdigest(b" ".join(p)) - (1 << 63) for p in parts]
            yield batch

    lines = split.mapInPandas(hashed, "_row long, source string, at int, text string, line long")
    flags = above.withColumn("above", F.lit(True))
    left = spread_join(lines, flags, ["source", "line"], F.col("_row"), how="left").where("above is null")
    texts_left = left.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x")).select("_row", F.array_join("x.text", "\n").alias("_left"))
    text = F.when(F.col("text").isNotNull(), F.coalesce("_left", F.lit("")))
    return rows.join(texts_left, "_row", "left").withColumn("text", text).select(*[quoted(c) for c in docs.columns])


def quality_filter(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, unchanged. Rows with the same id, source and text share their verdict."""
    gone = judge(docs, rules).where("not kept").select("id_key", F.col("source").alias("host"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), id_key(), host().alias("host"), text_hash())
    return rows.join(gone, ["id_key", "host", "text_hash"], "left_anti").select("row.*")
