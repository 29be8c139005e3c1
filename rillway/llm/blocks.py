"""Documents packed into compressed blocks, and the question which 64-bit names occur in several of them.

A block asks with the sorted distinct names it holds, cut by their leading bits into buckets. Each bucket is sorted on its own and
answers with one bit per name. Names need no address, copies within a block ask once, and however often a name occurs, a
bucket holds at most one of it per block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import saved

BLOCK_BYTES = 1 << 20
#: Names a bucket should hold: it is sorted in one task's memory.
BUCKET_NAMES = 1 << 21


@dataclass
class Block:
    ids: list
    data: np.ndarray  # bytes of all documents
    sizes: np.ndarray  # bytes of each document


def packed(docs: DataFrame) -> DataFrame:
    """block, n_bytes, payload: documents (doc_id, text; null counts as empty) in blocks of about BLOCK_BYTES, saved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = TaskContext.get().partitionId() << 33, 0
        ids, texts, size = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def close():
            payload = squeeze(pickle.dumps((ids, np.array([len(t) for t in texts], np.int64), b"".join(texts))))
            return pd.DataFrame({"block": [first + made], "n_bytes": [size], "payload": [payload]})

        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids.append(None if pd.isna(doc) else doc), texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield close()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield close()

    return saved(docs.select("doc_id", "text").mapInPandas(run, "block long, n_bytes long, payload binary"), "blocks")


def unpacked(payload: bytes) -> Block:
    ids, sizes, data = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
    return Block(ids, np.frombuffer(data, np.uint8), sizes)


def bucket_bits(names: int) -> int:
    """Leading bits by which so many names are cut into buckets."""
    return max(0, math.ceil(math.log2(max(1, names) / BUCKET_NAMES)))


def pressed(values: np.ndarray) -> bytes:
    """64-bit values as differences by planes of equal bytes: of sorted values the upper planes are nearly zero, and shrink
    when Spark compresses what it moves."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpressed(data: bytes, rows: int = 1) -> np.ndarray:
    """The values again, one row for each of so many pressed arrays of the same length."""
    planes = np.frombuffer(data, np.uint8).reshape(rows, 8, -1)
    return np.cumsum(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[..., 0], axis=1, dtype=np.uint64)


def questions(block: int, names: np.ndarray, bits: int, *more: np.ndarray) -> pd.DataFrame:
    """bucket, block, names: the sorted distinct names of a block by bucket, each bucket's values of `more` behind its names."""
    edges = np.searchsorted(names >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(names)])
    full = np.flatnonzero(np.diff(edges))
    return pd.DataFrame({"bucket": full, "block": block, "names": [b"".join(pressed(x[edges[k] : edges[k + 1]]) for x in (names, *more)) for k in full]})


def answers(asked: DataFrame) -> DataFrame:
    """block, bucket, mask: for each name of a question, whether another block holds it too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpressed(x)[0] for x in group["names"]]
        names = np.sort(np.concatenate(parts))
        twice = np.unique(names[1:][names[1:] == names[:-1]])
        masks = []
        for part in parts:
            at = np.searchsorted(twice, part)
            hit = np.zeros(len(part), bool)
            inside = at < len(twice)
            hit[inside] = twice[at[inside]] == part[inside]
            masks.append(np.packbits(hit).tobytes())
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "mask": masks})

    return asked.groupBy("bucket").applyInPandas(run, "block long, bucket long, mask binary")


def answered(names: np.ndarray, bits: int, replies: pd.DataFrame) -> np.ndarray:
    """For each of a block's sorted distinct names, whether another block holds it."""
    hit = np.zeros(len(names), bool)
    buckets = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    for bucket, mask in zip(replies["bucket"], replies["mask"]):
        low, high = np.searchsorted(buckets, [bucket, bucket + 1])
        hit[low:high] = np.unpackbits(np.frombuffer(mask, np.uint8), count=high - low).astype(bool)
    return hit


def with_replies(blocks: DataFrame, replies: DataFrame, fn: Callable[[int, bytes, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn(block, payload, its replies) for every block; a block without replies gets an empty table."""

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return fn(int(own["block"].iloc[0]), own["payload"].iloc[0], told)

    return blocks.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, schema)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima of pieces of that size, forwards and backwards, meet in two halves."""
    count = max(0, len(values) - width + 1)
    pieces = np.full((-(-len(values) // width), width), np.iinfo(np.uint64).max, np.uint64)
    pieces.ravel()[: len(values)] = values
    ahead = np.minimum.accumulate(pieces, axis=1).ravel()
    behind = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes").alias("n")).first().n or 0
