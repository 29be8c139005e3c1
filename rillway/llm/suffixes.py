"""Removal of repeated substrings, by a difference cover of the suffixes and buckets sorted one at a time.

A suffix counts as far as `length` bytes. Naming every suffix of the corpus would move eight bytes per byte of text. A
difference cover D modulo v has, for any two positions i and j, a shift d < v that takes both into D. So if the strings
at i and j agree for `length` bytes, the cover samples at i + d and j + d agree for length - v + 1 bytes.

1. Cover samples, about 6.5 % of the positions, are named by the hash of that many bytes and sorted, one bucket at a time.
2. A suffix can only be repeated if a cover sample among its first v bytes is; the others, nearly all, drop out here. This
   takes the place of comparing long ties by the samples' ranks: equal names are all that removal needs, not the order.
3. The suffixes left fall into segments, runs of neighbours that have the same smallest sample name among their bytes. Equal
   suffixes have equal smallest names. A segment is named by the hash of all bytes its strings cover: if another block holds
   the same bytes, all its suffixes are repeated, and one block speaks for them from here on.
4. Where a smallest name has several different segments, their suffixes (one block's for each) are named by the hash of all
   their `length` bytes and sorted bucket by bucket; equal neighbours are repeats. These are the ends of repeated passages.
Bytes that a repeated string covers are removed. Memory is bounded by a bucket, a block of documents, or one long document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.blocks import Block, answered, answers, bucket_bits, least_of, packed, questions, total_bytes, unpacked, unpressed, with_replies
from rillway.llm.common import saved

LENGTH = 400
SEGMENT = 1 << 20
RADIX = np.uint64(0x5851F42D4C957F2D)


def difference_cover(r: int) -> tuple[np.ndarray, int]:
    """A cover of 6r + 4 residues modulo 24r^2 + 36r + 13: every difference modulo v is one of two members (Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.cumsum([0, *steps]), 24 * r * r + 36 * r + 13


def cover_for(length: int) -> tuple[np.ndarray, int]:
    """The largest cover whose samples still have half a dozen bytes to compare; every position for short lengths."""
    r = max((r for r in range(20) if 24 * r * r + 36 * r + 13 <= length - 6), default=None)
    return (np.array([0]), 1) if r is None else difference_cover(r)


def powers(radix: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, radix, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


INVERSE = np.uint64(pow(int(RADIX), -1, 1 << 64))
UP, DOWN = None, None


def window_names(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window of `length` bytes, by differences of one running sum modulo 2^64."""
    global UP, DOWN
    if UP is None or len(UP) < SEGMENT + length:
        UP, DOWN = powers(RADIX, SEGMENT + length), powers(INVERSE, SEGMENT + length)
    table = np.random.Generator(np.random.PCG64(12345)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    count = max(0, len(data) - length + 1)
    out = np.empty(count, np.uint64)
    for a in range(0, count, SEGMENT):
        part = data[a : min(len(data), a + SEGMENT + length - 1)]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * UP[: len(part)], out=run[1:])
        names = (run[length:] - run[:-length]) * DOWN[: len(run) - length]
        names ^= names >> np.uint64(31)
        names *= np.uint64(0x9E3779B97F4A7C15)
        out[a : a + len(names)] = names ^ (names >> np.uint64(29))
    return out


def places(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, its place in its document and the bytes from it to the document's end."""
    starts = np.cumsum(block.sizes) - block.sizes
    place = np.arange(len(block.data)) - np.repeat(starts, block.sizes)
    return place, np.repeat(block.sizes, block.sizes) - place


def named(block: Block, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names of the chosen windows, each window's index among them, and whether the block repeats a name."""
    names, index, counts = np.unique(window_names(block.data, length)[chosen], return_inverse=True, return_counts=True)
    return names, index, counts > 1


def expanded(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """All numbers from each low to its high."""
    sizes = highs - lows + 1
    return np.arange(sizes.sum()) + np.repeat(lows - np.cumsum(sizes) + sizes, sizes)


def segments(block: Block, start: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, smallest sample name and the name of all covered bytes of each segment of the starts."""
    least = least_of(window_names(block.data, short), length - short + 1)[start]
    cuts = np.flatnonzero((np.diff(start, prepend=-2) > 1) | (least != np.roll(least, 1)))
    lows, highs = start[cuts], start[np.append(cuts, len(start))[1:] - 1]
    data = memoryview(block.data)
    covered = (xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(lows.tolist(), highs.tolist()))
    return lows, highs, least[cuts], np.fromiter(covered, np.uint64, len(lows))


def segment_answers(asked: DataFrame, bits: int) -> DataFrame:
    """block, bucket, mask. For names of segments, two bits: another block holds it, and this block is the first that does.
    For smallest names (buckets from 2^bits on), one bit: there are different segments under it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        covered = int(group["bucket"].iloc[0]) < 1 << bits
        parts = [unpressed(x, 1 if covered else 3) for x in group["names"]]
        names = np.concatenate(parts, axis=1)
        distinct, first, index, counts = np.unique(names[0], return_index=True, return_inverse=True, return_counts=True)
        if covered:
            bit = np.stack([counts[index] > 1, first[index] == np.arange(len(index))])
        else:
            low, high = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(distinct), np.uint64)
            np.minimum.at(low, index, names[1]), np.maximum.at(high, index, names[2])
            bit = (low != high)[index][None]
        split = np.split(bit, np.cumsum([p.shape[1] for p in parts])[:-1], axis=1)
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "mask": [np.packbits(x, axis=1).tobytes() for x in split]})

    return asked.groupBy("bucket").applyInPandas(run, "block long, bucket long, mask binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for each row of docs (doc_id, text).

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same document or another.
    A null text is empty; ids need not be distinct or there at all. Windows are compared by 64-bit hashes.
    """
    cover, v = cover_for(length)
    short = length - v + 1
    blocks = packed(docs)
    size = total_bytes(blocks)
    bits = bucket_bits(size * len(cover) // v)
    in_cover = np.zeros(v, bool)
    in_cover[cover] = True

    def samples(block: Block) -> np.ndarray:
        place, room = places(block)
        return np.flatnonzero(in_cover[place % v] & (room >= short))

    def ask_samples(batches):
        for batch in batches:
            for key, payload in zip(batch["block"], batch["payload"]):
                block = unpacked(payload)
                yield questions(key, named(block, samples(block), short)[0], bits)

    asked = blocks.select("block", "payload").mapInPandas(ask_samples, "bucket long, block long, names binary")
    first = saved(answers(asked), "suffix-samples")
    schema = "bucket long, block long, names binary"

    def note(key: int, lows: np.ndarray, highs: np.ndarray) -> pd.DataFrame:
        """A block's note to its next steps: the runs of its starts that may be repeated."""
        return pd.DataFrame({"bucket": [-1], "block": [key], "names": [np.concatenate([lows, highs]).astype(np.int64).tobytes()]})

    def ask_segments(key: int, payload: bytes, told: pd.DataFrame) -> pd.DataFrame:
        block = unpacked(payload)
        at = samples(block)
        names, index, twice = named(block, at, short)
        repeated = twice | answered(names, bits, told)
        alike = np.zeros(len(block.data) + 1, np.int64)
        alike[at[repeated[index]] + 1] = 1
        alike = np.cumsum(alike)  # repeated samples before each byte
        _, room = places(block)
        start = np.flatnonzero(room >= length)
        start = start[alike[start + v] > alike[start]]
        if not len(start):
            return note(key, start, start)
        _, _, least, covered = segments(block, start, short, length)
        keys, index = np.unique(least, return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(keys), np.uint64)
        np.minimum.at(low, index, covered), np.maximum.at(high, index, covered)
        ties = questions(key, keys, bits, low, high)
        ties["bucket"] += 1 << bits
        runs = np.flatnonzero(np.diff(start, prepend=-2) > 1)
        return pd.concat([note(key, start[runs], start[np.append(runs, len(start))[1:] - 1]), questions(key, np.unique(covered), bits), ties])

    second = saved(with_replies(blocks, first, ask_segments, schema), "suffix-segments")
    notes = second.where("bucket < 0").select("block", "bucket", F.col("names").alias("mask"))
    second = saved(segment_answers(second.where("bucket >= 0"), bits).union(notes), "suffix-ties")

    def standing(block: Block, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts that may be repeated; whether another block holds their segment; whether this block must ask for them."""
        runs = [np.frombuffer(x, np.int64).reshape(2, -1) for x in told["mask"][told["bucket"] == -1]]
        start = expanded(*runs[0]) if runs else np.zeros(0, np.int64)
        if not len(start):
            return start, start > 0, start > 0
        lows, highs, least, covered = segments(block, start, short, length)
        names, index = np.unique(covered, return_inverse=True)
        replies = told[told["bucket"].between(0, (1 << bits) - 1)]
        half = replies["mask"].str.len() // 2
        elsewhere = answered(names, bits, replies.assign(mask=[m[:k] for m, k in zip(replies["mask"], half)]))[index]
        speaks = answered(names, bits, replies.assign(mask=[m[k:] for m, k in zip(replies["mask"], half)]))[index]
        keys, index = np.unique(least, return_inverse=True)
        ties = told[told["bucket"].between(1 << bits, (2 << bits) - 1)]
        speaks &= answered(keys, bits, ties.assign(bucket=ties["bucket"] - (1 << bits)))[index]
        sizes = highs - lows + 1
        return start, np.repeat(elsewhere, sizes), np.repeat(speaks, sizes)

    def ask_suffixes(key: int, payload: bytes, told: pd.DataFrame) -> pd.DataFrame:
        block = unpacked(payload)
        start, _, speaks = standing(block, told)
        return questions(key, named(block, start[speaks], length)[0], bits)

    # Not saved: only its answers go on, and both steps share one exchange of the blocks.
    third = answers(with_replies(blocks, second, ask_suffixes, schema))
    told = second.union(third.select("block", (F.col("bucket") + (2 << bits)).alias("bucket"), "mask"))

    def cut(key: int, payload: bytes, told: pd.DataFrame) -> pd.DataFrame:
        block = unpacked(payload)
        gone = np.zeros(len(block.data) + 1, np.int64)
        start, hit, speaks = standing(block, told)
        if len(start):
            names, index, twice = named(block, start, length)
            asked, at = np.unique(names[index[speaks]], return_inverse=True)
            replies = told[told["bucket"] >= 2 << bits]
            hit |= twice[index]
            hit[speaks] |= answered(asked, bits, replies.assign(bucket=replies["bucket"] - (2 << bits)))[at]
            np.add.at(gone, start[hit], 1)
            np.subtract.at(gone, start[hit] + length, 1)
        gone = np.cumsum(gone)[:-1] > 0
        rows = []
        for doc, end, n in zip(block.ids, np.cumsum(block.sizes), block.sizes):
            own = gone[end - n : end]
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            rows.append((doc, int(n), int(own.sum()), spans, block.data[end - n : end][~own].tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "object"})

    kind = dict(docs.dtypes)["doc_id"]
    return with_replies(blocks, told, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

