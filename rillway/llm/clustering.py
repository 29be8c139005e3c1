"""Centroid clustering over subvector dictionaries.

Vectors are written once, in chunks of rows. In each chunk the dimensions form blocks, and a block is kept as the distinct
subvectors that occur there (its dictionary) and one code per vector; nothing is rounded. A round computes the exact distance of
each dictionary entry to each centroid, once per chunk, and a vector's distance is the sum over its codes. Blocks start as single dimensions and
neighbours are joined as long as their dictionary stays small against the chunk. Chunks stay where they are: a round moves
sums per centroid only, and the centroids are all that is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import saved

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of a chunk, and the share of them that the distinct subvectors of a joined block may come to.
CHUNK, DICTIONARY_SHARE = 32_768, 0.25
#: Distances (vectors times centroids) that a task holds at once.
AT_ONCE = 1 << 21
BLOCKS = "array<struct<first: int, width: int, entries: binary, codes: binary>>"
CHUNKS = f"ids array<bigint>, blocks {BLOCKS}"


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int, id_column: str, vector: str) -> DataFrame:
    """id, v: those with exactly `dimensions` components, none null or not finite, as floor(scale * x). A squared distance must fit
    into a long, so components beyond what that allows (for 64 dimensions 1.8e8 either way) are set to that bound."""
    most = float(math.isqrt((2**63 - 1) // dimensions) // 2)
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), x.alias("v")).where(F.size("v") == dimensions)
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    bounded = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(most)), F.lit(-most)))
    return rows.select("id", F.transform("v", bounded).alias("v"))


def joined(a: tuple, b: tuple, most: float) -> tuple | None:
    """Two neighbouring blocks (first, entries, codes) as one, unless its dictionary has more than `most` entries."""
    both, at, codes = np.unique(a[2].astype(np.int64) * len(b[1]) + b[2], return_index=True, return_inverse=True)
    if len(both) > most:
        return None
    return a[0], np.hstack([a[1][a[2][at]], b[1][b[2][at]]]), codes


def encoded(v: np.ndarray, share: float = DICTIONARY_SHARE) -> list[tuple]:
    """The blocks (first dimension, entries x width, code of each vector) of a chunk."""
    blocks = []
    for i in range(v.shape[1]):
        entries, codes = np.unique(v[:, i], return_inverse=True)
        blocks.append((i, entries[:, None], codes))
    while True:
        out, i = [], 0
        while i < len(blocks):
            new = joined(blocks[i], blocks[i + 1], share * len(v)) if i + 1 < len(blocks) else None
            out.append(new or blocks[i])
            i += 2 if new else 1
        if len(out) == len(blocks):
            return out
        blocks = out


def chunks_of(batches: Iterator[pa.RecordBatch], dimensions: int, rows: int) -> Iterator[pa.RecordBatch]:
    def chunk(ids, parts):
        v = np.concatenate(parts)
        kind = np.uint16 if len(v) <= 1 << 16 else np.uint32
        found = [{"first": i, "width": e.shape[1], "entries": e.astype("<i8").tobytes(), "codes": c.astype(kind).tobytes()} for i, e, c in encoded(v)]
        block = pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("codes", pa.binary())]))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], pa.concat_arrays(ids)), pa.array([found], block)], ["ids", "blocks"])

    ids, parts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            ids.append(piece.column("id").cast(pa.int64()))
            parts.append(piece.column("v").flatten().to_numpy().reshape(-1, dimensions))
            held += piece.num_rows
            if held >= rows:
                yield chunk(ids, parts)
                ids, parts, held = [], [], 0
    if held:
        yield chunk(ids, parts)


def opened(blocks: list[dict], n: int) -> list[tuple]:
    """As encoded() made them."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    return [(b["first"], np.frombuffer(b["entries"], "<i8").reshape(-1, b["width"]), np.frombuffer(b["codes"], kind)) for b in blocks]


def nearest(blocks: list[tuple], n: int, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (the smallest number among the nearest) and squared distance of each vector of a chunk."""
    tables = [((entries[:, None, :] - centroids[None, :, first : first + entries.shape[1]]) ** 2).sum(2) for first, entries, _ in blocks]
    cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    step = max(1, AT_ONCE // len(centroids))
    for at in range(0, n, step):
        total = sum(table[codes[at : at + step]] for table, (_, _, codes) in zip(tables, blocks))
        cluster[at : at + step] = total.argmin(1)
        distance[at : at + step] = total.min(1)
    return cluster, distance


def partial_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cluster, dimension (-1: the number of vectors), total for each chunk. Sums come from the dictionaries: how often a
    cluster holds each code, times the entry."""
    k = len(centroids)
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["ids"])
            blocks = opened(row["blocks"], n)
            cluster, _ = nearest(blocks, n, centroids)
            sums = np.zeros((k, centroids.shape[1] + 1), np.int64)
            sums[:, -1] = np.bincount(cluster, minlength=k)
            for first, entries, codes in blocks:
                held = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                sums[:, first : first + entries.shape[1]] = held @ entries
            there = np.flatnonzero(sums[:, -1])
            dims = [*range(centroids.shape[1]), -1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(there, len(dims)).astype(np.int32)), pa.array(np.tile(dims, len(there)).astype(np.int32)), pa.array(sums[there].ravel())],
                ["cluster", "dimension", "total"],
            )


def assignments(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            cluster, distance = nearest(opened(row["blocks"], len(row["ids"])), len(row["ids"]), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def start(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; all of them where there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()], np.int64)


def moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the exact mean per component; those without vectors stay."""
    parts = chunks.mapInArrow(lambda it: partial_sums(it, centroids), "cluster int, dimension int, total bigint")
    out = centroids.copy()
    counts, sums = {}, []
    for r in parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        if r.dimension < 0:
            counts[r.cluster] = int(r.total)
        else:
            sums.append((r.cluster, r.dimension, int(r.total)))
    for cluster, dimension, total in sums:
        out[cluster, dimension] = total // counts[cluster]
    return out


def clusters_of(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
    id_column: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK,
) -> tuple[DataFrame, list[list[int]]]:
    """id column, cluster and distance of each vector that is kept, and the final centroids.

    Ids are whole numbers or null. Vectors of another length, null ones and those with a null or not finite component are
    left out; a table without others gives no rows and no centroids. Repeated rows count one by one, other columns are ignored.
    With fewer vectors than clusters, each vector starts one. Needs memory for a chunk and for AT_ONCE distances a task.
    """
    kept = kept_vectors(vectors, dimensions, scale, id_column, vector)
    chunks = saved(kept.mapInArrow(lambda it: chunks_of(it, dimensions, chunk), CHUNKS), "cluster-chunks")
    centroids = start(kept, clusters, seed)
    if not len(centroids):
        return kept.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    for _ in range(rounds):
        centroids = moved(chunks, centroids)
    final = centroids
    found = chunks.mapInArrow(lambda it: assignments(it, final), "id bigint, cluster int, distance bigint")
    return saved(found, "cluster-assigned").withColumnRenamed("id", id_column), final.tolist()


def cluster_table(vectors: DataFrame, **options) -> DataFrame:
    """clusters_of() with each cluster's and the whole inertia (at most the largest long) and the digest of its centroid."""
    found, centroids = clusters_of(vectors, **options)
    per = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    long = lambda n: min(n, 2**63 - 1)
    rows = [(i, long(per.get(i, 0)), long(sum(per.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(*found.columns, "cluster_inertia", "inertia", "centroid_sha256")
