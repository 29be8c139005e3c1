"""Jaccard self-join on word shingles by size-banded tiles with hashed bitmaps.

1. A document's set is the sorted array of its distinct hashed shingles. Equal sets form one class, which goes on once.
2. Two sets of the wanted similarity share one of the rarest few shingles of each (their prefixes), and their sizes lie in
   the same or in neighbouring bands. So (prefix shingle, band) are the keys of the tiles. Rarity is read from a table of
   shingle counts in 2^18 hashed cells, so a passage that many documents share comes last in every prefix.
3. Stars: in each tile the members meet the tile's first member only (two that share a shingle with no third are one
   pair). Their exact links give first components; large
   groups of near copies are one component from here on.
4. Tiles that still hold several components are cut into blocks and compared block by block. Every member brings a bitmap
   of its shingles: from the bits that differ follows the most the two sets can share. Pairs within reach go on. The tokens
   of a member are in one order for all, and two members that came from the same token have met there already, so a
   passage of many shingles does not bring the same pair up once for each.
5. Pairs are checked by exact intersection of the sorted arrays.
No link between components is lost: a pair that was not compared lies within one component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import checked_broadcast, saved, spread_join
from rillway.llm.components import components

CELL_BITS = 18
BITMAP_WORDS = 16
TILE = 256
KNOWN_WORDS = 200_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """Hashes of the words seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of all its words if they are fewer than `width`."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashed[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit per hash, of 64 * BITMAP_WORDS; hashes may share a bit."""
    bits = np.zeros(64 * BITMAP_WORDS, bool)
    bits[(hashes >> np.uint64(20)) % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.uint64)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    doc_id, n, set_id (a 128-bit digest of the set) and bits of each document; and cell, k: the shingles a task has seen
    in each hashed cell, added up over its documents.
    """
    schema = "doc_id long, n long, set_id string, bits array<long>, cell long, k long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = WordHashes(), np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 256)):
                sets = [shingle_set(t, width, known) for t in batch["text"].iloc[part]]
                if sets:
                    counts += np.bincount(cell(np.concatenate(sets)), minlength=len(counts))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[part].astype("Int64"), "n": [len(s) for s in sets],
                    "set_id": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "bits": [bitmap(s).view(np.int64) for s in sets],
                    "cell": pd.NA, "k": pd.NA,
                })
        for full in np.array_split(np.flatnonzero(counts), 8):
            yield pd.DataFrame({"doc_id": pd.NA, "n": pd.NA, "set_id": None, "bits": None, "cell": full, "k": counts[full]})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def size_band(percent: int):
    """Sets of the wanted similarity lie in the same or in neighbouring bands (these are a little wider than need be)."""
    return F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-math.log(percent / 100 - 0.005)))


def prefixes(docs: DataFrame, width: int, percent: int, rarity) -> DataFrame:
    """id, token: the prefix shingles of each document, the rarest ones by the ranks of their cells. Of equal sets that one task
    meets, the first stands for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ranks, seen = WordHashes(), rarity.value, set()
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), max(1, len(batch) // 1024)):
                ids, tokens = [], []
                for doc, text in zip(batch["doc_id"].iloc[part], batch["text"].iloc[part]):
                    hashes = shingle_set(text, width, known)
                    if not len(hashes) or (digest := xxhash.xxh3_128_digest(hashes.tobytes())) in seen:
                        continue
                    seen = seen if len(seen) < KNOWN_WORDS else set()
                    seen.add(digest)
                    keep = len(hashes) - -(-percent * len(hashes) // 100) + 1
                    order = np.argsort(ranks[cell(hashes)], kind="stable")[:keep]  # by rank, then by hash, as hashes are sorted
                    ids.append(np.full(keep, doc, np.int64)), tokens.append(hashes[order])
                if ids:
                    yield pd.DataFrame({"id": np.concatenate(ids), "token": np.concatenate(tokens).view(np.int64)})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "id long, token long")


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit ranks that rise with them (steps of 0.07 %), which sort in linear time. Every order that all documents
    share gives right prefixes."""
    return np.round(np.log2(counts + 1.0) * 1000).astype(np.uint16)


def shared_count(own: np.ndarray, other: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not len(own) or not len(other):
        return 0
    at = np.searchsorted(own, other)
    at[at == len(own)] = 0
    return int(np.count_nonzero(own[at] == other))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents in ids. Up to a stated number of ids is broadcast; beyond it both sides are shuffled."""
    ids = saved(ids.select("id").distinct(), "shingle-ids")
    found = docs.select(F.col("doc_id").alias("id"), "text").join(checked_broadcast(ids), "id", "left_semi")
    one = Window.partitionBy("id").orderBy("text")  # rows may repeat an id
    return found.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("id", "text")


def linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection of the sorted arrays.

    The texts meet and not the arrays, which compress badly and take thrice the space. The smaller id is joined last, so that
    a star's pairs lie together and its hub's array is made once.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, hub, own = WordHashes(), None, None
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["x"], batch["y"])):
                if a != hub:
                    hub, own = a, shingle_set(x, width, known)
                other = shingle_set(y, width, known)
                both = shared_count(own, other)
                good[i] = 100 * both >= percent * (len(own) + len(other) - both)
            yield batch.loc[good, ["a", "b"]]

    pairs = saved(pairs, "shingle-pairs")
    texts = texts_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")


def within_reach(x: str, m: str, y: str, n: str, percent: int):
    """Sizes and bitmaps allow the similarity: of m + n members, those behind differing bits are not shared."""
    differ = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITMAP_WORDS)), F.lit(0))
    most = (F.col(m) + F.col(n) - differ) / 2
    sizes = 100 * F.least(m, n) >= percent * F.greatest(m, n)
    return sizes & (100 * most >= percent * (F.col(m) + F.col(n) - most))


def across(members: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of one token's members (token, id, band, n, component) from different components, within reach.

    Each (token, band) is cut into blocks of about TILE members. A member visits the later blocks of its own band and all
    blocks of the next; it is compared there inside the join, which returns the pairs within reach only, each once for every
    token they share after different ones.
    """
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("id").orderBy("k", "token")
    members = saved(members.join(sizes, "token").withColumn("before", F.lag("token").over(order)).drop("k"), "shingle-ordered")
    blocks = members.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    above = blocks.select("token", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    dealt = members.join(blocks.join(above, ["token", "band"], "left"), ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = saved(dealt, "shingle-dealt")
    own = F.transform(F.sequence("block", F.col("blocks") - 1), lambda k: F.struct(F.col("band").alias("band"), k.alias("block")))
    upper = F.when(F.col("above").isNull(), F.array().cast("array<struct<band:bigint,block:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: F.struct((F.col("band") + 1).alias("band"), k.alias("block")))
    )
    visits = dealt.withColumn("to", F.explode(F.concat(own, upper)))
    home = (F.col("to.band") == F.col("band")) & (F.col("to.block") == F.col("block"))
    a = visits.select("token", F.col("to.band").alias("band"), F.col("to.block").alias("block"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("component").alias("ca"), home.alias("home"), F.col("before").alias("pa"))
    b = dealt.select("token", "band", "block", F.col("id").alias("b"), "n", F.col("component").alias("cb"), F.col("before").alias("pb"))
    a = a.join(signs.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a")
    b = b.join(signs.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    # two members with the same token before this one share that too; if they share any, they meet at the first of them
    fresh = "ca <> cb and (not home or a < b) and (pa is null or pb is null or pa <> pb)"
    met = a.join(b, ["token", "band", "block"]).where(fresh).where(within_reach("x", "m", "y", "n", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text): the smallest doc_id reachable by links.

    Two documents link when 100 * shared >= percent * union of their distinct shingles of `width` words. Without words
    (or text) a document has no shingle and links with nothing. Rows without an id take the component of their set;
    rows that share an id are one document with several texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first_pass = saved(described(docs, width), "shingle-sets")
    rows = first_pass.where("set_id is not null").select("doc_id", "n", "set_id", "bits")
    classes = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    of_doc = saved(spread_join(rows.where("n > 0").drop("bits"), classes, ["set_id"], F.col("doc_id")), "shingle-classes")

    counts = np.zeros(1 << CELL_BITS, np.int64)
    table = first_pass.where("cell is not null").groupBy("cell").agg(F.sum("k").alias("k")).toPandas()  # 2^CELL_BITS rows at most
    counts[table["cell"].to_numpy()] = table["k"].to_numpy()
    rarity = spark.sparkContext.broadcast(rarity_ranks(counts))
    tokens = saved(prefixes(docs, width, percent, rarity), "shingle-prefixes")

    # counted where they are sorted by token, so the tokens are moved once
    shared = tokens.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("k > 1").select("id", "token")
    nodes = of_doc.where("doc_id is not null").select(F.col("doc_id").alias("id"), "rep", "n").distinct()
    members = shared.join(nodes, "id").select("token", F.col("rep").alias("id"), "n", size_band(percent).alias("band")).distinct()
    members = saved(members, "shingle-members")

    signs = rows.where("n > 0 and doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", "bits")
    of_token = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).where("k > 1")
    couples = of_token.where("k = 2").select("a", "b")  # no more to compare there
    members = members.join(of_token.where("k > 2").select("token"), "token", "left_semi")
    hubs = members.groupBy("token", "band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    stars = members.join(hubs, ["token", "band"]).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    stars = stars.union(couples).distinct()
    a = signs.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    b = signs.select(F.col("id").alias("b"), "n", F.col("bits").alias("y"))
    stars = saved(stars.join(a, "a").join(b, "b").where(within_reach("x", "m", "y", "n", percent)).select("a", "b"), "shingle-stars")
    first = saved(linked(stars, docs, width, percent), "shingle-links")

    found = components(first)
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = saved(placed, "shingle-placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("token")
    open_members = placed.join(mixed, "token", "left_semi")
    pairs = across(open_members, signs, percent).join(stars, ["a", "b"], "left_anti")
    links = first.union(linked(pairs, docs, width, percent))

    final = components(links).withColumnRenamed("id", "rep")
    named = of_doc.select("doc_id", "n", "rep").join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return named.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs whose doc_id, a whole number, is their component's smallest, or null; all columns are returned.

    Of rows that repeat an id, those with the component's first id stay.
    """
    gone = ngram_join(docs, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
