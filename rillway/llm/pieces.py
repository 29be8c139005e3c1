"""SentencePiece encoding and decoding of a BPE model with byte fallback, over a relational lattice.

Spaces become U+2581 and one is put in front. No piece holds that mark after another character, so a text falls into units, a
run of marks with the characters up to the next, which are encoded alone. The most frequent units (LATTICE_UNITS of them)
go through the lattice: their substrings, bounded by the longest piece, are exploded and equi-joined to the piece table,
the edges are grouped by unit, and a higher-order aggregate folds them into the best path. For BPE the best path is
not the one of the highest score sum: the model joins the best-ranked pair of neighbours, leftmost first, until none is
left. So the fold's state is the list of cuts, and each step takes the best edge that spans two neighbours.

The resulting table has a bounded number of rows and is broadcast. Units outside it, most of which occur once, are encoded
where they occur by the same rule (merged_ids). Joining every occurrence to its unit would shuffle the text several times.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.columns import quoted
from rillway.llm.common import saved

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LATTICE_UNITS = 1 << 17
#: Longer units stay out of the lattice: the fold's work grows with the square of a unit.
LATTICE_LENGTH = 32
KEEP_UNITS = 400_000
#: Up to this length the next merge is found by search, beyond it by a heap; both give the same pieces.
SHORT_UNIT = 64
NO_RANK = 1 << 30


@dataclass(frozen=True)
class PieceModel:
    """id and rank (smaller merges first) of the pieces, the first byte piece, and the bytes of every id (control ids: none)."""

    ids: dict[str, int]
    ranks: dict[str, int]
    first_byte: int
    texts: list[bytes]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))


def load_model(path: str) -> PieceModel:
    """A BPE model with byte fallback and without text rules of its own, such as piece_bpe_32k.model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ranks, texts, first_byte = {}, {}, [], -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first_byte = i if first_byte < 0 else first_byte
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            ids[piece], ranks[piece] = i, round(-model.get_score(i))
            texts.append(piece.encode())
    if first_byte < 0:
        raise ValueError("the model has no byte pieces")
    return PieceModel(ids, ranks, first_byte, texts)


def public_model() -> PieceModel:
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


def units_of(text: str | None) -> list[str]:
    return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def plain_parts(text: str) -> list[str] | None:
    """The units of a text without the mark each begins with, if single spaces alone part them; None for other texts."""
    parts = text.split(" ")
    return None if "" in parts or MARK in text else parts


def merged_ids(unit: str, ids: dict[str, int], ranks: dict[str, int], first_byte: int) -> list[int]:
    """The ids of one unit: best-ranked pair first, leftmost first among equals."""
    out: list[int] = []
    for p in merged_short(unit, ranks) if len(unit) <= SHORT_UNIT else merged_long(unit, ranks):
        known = ids.get(p)
        if known is not None:
            out.append(known)
        else:
            out += [first_byte + b for b in p.encode()]
    return out


def merged_short(unit: str, ranks: dict[str, int]) -> list[str]:
    """The pieces of a unit, the next pair by search over all that are left: the least work as long as they are few."""
    parts = list(unit)
    found = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while found and (best := min(found)) < NO_RANK:
        i = found.index(best)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return parts


def merged_long(unit: str, ranks: dict[str, int]) -> list[str]:
    """The same pieces from a heap of pairs, in n log n steps whatever the length."""
    parts: list[str] = list(unit)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(unit[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, length = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != length or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (rank := ranks.get(joined := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (rank, left, len(joined)))
    return [p for p in parts if p]


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, n over all documents; each task adds up its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"unit": [u if u[0] == MARK else MARK + u for u in counts], "n": list(counts.values())})

        for batch in batches:
            for text in batch["text"]:
                if text:
                    counts.update(plain_parts(text) or units_of(text))
                if len(counts) > KEEP_UNITS:
                    yield counted()
                    counts.clear()
        if counts:
            yield counted()

    return docs.select("text").mapInPandas(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, most: int = LATTICE_UNITS, longest: int = LATTICE_LENGTH) -> DataFrame:
    """The most frequent units, `most` at most: a histogram of the counts gives the least count that is frequent."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    counts = saved(unit_counts(docs).where(F.char_length("unit") <= longest).withColumn("step", step), "units")
    total, least = 0, None
    for row in counts.groupBy("step").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():  # at most 16 * 63 rows
        total += row.k
        if total > most:
            break
        least = row.step
    return counts.where(F.col("step") >= (least if least is not None else 1 << 30)).select("unit")


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    rows = {"piece": list(model.ids), "id": list(model.ids.values()), "rank": [model.ranks[p] for p in model.ids]}
    return spark.createDataFrame(pd.DataFrame(rows), "piece string, id int, rank int")


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """unit, tokens of a table of distinct units, through the lattice."""
    start = F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("unit")), lambda i: F.col("unit").substr(i, F.lit(model.longest)))).alias("start", "rest")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced: small rows, long work
    tails = units.repartition(parts, "unit").select("unit", start)
    spans = tails.select("unit", "start", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("rest")), lambda k: F.col("rest").substr(F.lit(1), k))).alias("piece"))
    edges = spans.join(F.broadcast(piece_table(units.sparkSession, model)), "piece")  # the vocabulary bounds its size
    edge = F.struct("rank", "start", "id", (F.col("start") + F.char_length("piece")).alias("end"))
    # Dealt by unit before the explode, so that neither the grouping nor this join moves the edges.
    lattice = units.join(edges.groupBy("unit").agg(F.collect_list(edge).alias("edges")), "unit", "left")
    lattice = lattice.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<rank:int,start:int,id:int,end:int>>")))

    def best(cuts, edges):
        joins = F.filter(edges, lambda e: (F.array_position(cuts, e["start"]) > 0) & (F.array_position(cuts, e["end"]) - F.array_position(cuts, e["start"]) == 2))
        return F.array_min(joins)

    def step(cuts, _):
        found = F.array(best(cuts, F.col("edges")))
        return F.flatten(F.transform(found, lambda e: F.when(e.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= e["start"]) | (c >= e["end"])))))

    def ids(cuts):
        def of(i):
            begin, end = F.element_at(cuts, i), F.element_at(cuts, i + 1)
            known = F.filter("edges", lambda e: (e["start"] == begin) & (e["end"] == end))
            letter = F.hex(F.encode(F.col("unit").substr(begin + 1, F.lit(1)), "UTF-8"))
            numbers = F.transform(F.sequence(F.lit(1), F.length(letter), F.lit(2)), lambda k: F.conv(F.substring(letter, k, F.lit(2)), 16, 10).cast("int") + model.first_byte)
            return F.when(F.size(known) > 0, F.transform(known, lambda e: e["id"])).otherwise(numbers)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), of))

    length = F.char_length("unit")
    steps = F.slice(F.sequence(F.lit(1), length), F.lit(1), length - 1)
    return lattice.select("unit", F.aggregate(steps, F.sequence(F.lit(0), length), step, ids).alias("tokens"))


def decoded(tokens: list[int], texts: list[bytes]) -> str:
    """The text of token ids: marks are spaces, the one in front is dropped."""
    out = b"".join([texts[i] for i in tokens]).decode("utf-8", "replace").replace(MARK, " ")
    return out[1:] if out.startswith(" ") else out


def encode(docs: DataFrame, model: PieceModel, most: int = LATTICE_UNITS) -> DataFrame:
    """The columns of docs, and tokens (array of ids) and round_trip: decoding gives the text back, marks as spaces.

    A null or empty text has no tokens. Columns of docs named tokens or round_trip are replaced.
    """
    table = encode_units(frequent_units(docs, most), model).toPandas()  # LATTICE_UNITS rows at most
    known = {u: np.asarray(t, np.int32).tobytes() for u, t in zip(table["unit"], table["tokens"])}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, model.ids, model.ranks, model.first_byte, model.texts))  # plain values: no class to import
    rest = [quoted(c) for c in docs.columns if c not in ("tokens", "round_trip", "text")]

    class Units(dict):
        """The packed ids of units met, by unit or by unit without its mark; emptied when there are too many. `odd` are those
        whose ids do not decode to the unit."""

        odd: set[str] = set()

        def __missing__(self, key):
            base, ids, ranks, first_byte, texts = shared.value
            unit = key if key[0] == MARK else MARK + key
            value = base.get(unit)
            if value is None:
                numbers = merged_ids(unit, ids, ranks, first_byte)
                value = struct.pack(f"{len(numbers)}i", *numbers)
            else:
                numbers = struct.unpack(f"{len(value) // 4}i", value)
            if len(self) > KEEP_UNITS:
                self.clear()
            if b"".join([texts[i] for i in numbers]) != unit.encode():
                self.odd.add(key)
            self[key] = value
            return value

    def run(batches):
        units, texts = Units(), shared.value[4]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found, trips = [], []
                for text in rows.column("text").to_pylist():
                    parts = (plain_parts(text) or units_of(text)) if text else []
                    packed = b"".join(map(units.__getitem__, parts))
                    found.append(packed)
                    # the bytes of a text's tokens are those of its units, one after another
                    whole = units.odd.isdisjoint(parts)
                    trips.append(whole or decoded(np.frombuffer(packed, np.int32).tolist(), texts) == text.replace(MARK, " "))
                ends = np.cumsum([0, *map(len, found)]) // 4
                numbers = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)
                yield pa.RecordBatch.from_arrays([*rows.columns, tokens, pa.array(trips, pa.bool_())], names=[*rows.schema.names, "tokens", "round_trip"])

    return _in_batches(docs.select(*rest, "text"), run, "text", "tokens array<int>, round_trip boolean", arrow=True)


def _in_batches(df: DataFrame, run, named: str | None, added: str, arrow: bool = False) -> DataFrame:
    """df.mapInPandas(run), or mapInArrow, with columns added, which takes no names with dots: all columns but one have numbers on the way."""
    names = [c if c == named else f"_{i}" for i, c in enumerate(df.columns)]
    plain = df.toDF(*names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    out = (plain.mapInArrow if arrow else plain.mapInPandas)(run, f"{kept}, {added}")
    return out.toDF(*df.columns, *out.columns[len(names):])


def decode(tokens: DataFrame, model: PieceModel) -> DataFrame:
    """The rows of a table with a column tokens, with its text as column "text"; null tokens give a null text."""
    texts = tokens.sparkSession.sparkContext.broadcast(model.texts)

    def run(batches):
        for batch in batches:
            yield batch.assign(text=[None if t is None else decoded(list(t), texts.value) for t in batch["tokens"]])

    rest = [quoted(c) for c in tokens.columns if c != "text"]
    return _in_batches(tokens.select(*rest), run, "tokens", "text string")
