"""A keyed target in files: a base of folded rows, and the change batches that came after it.

    <path>/base/<name>                       rows of every key seen so far, removed ones kept as markers, each with the
                                             positions it rests on, so that a fold over it equals one over its changes
    <path>/log/log_stream=S/log_batch=N      changes of one batch of a stream, rewritten when it is repeated
    <path>/commits/base=<name>               small rows per finished base: generation, version, and the last batch of
                                             each stream it contains

A stream is named by the id in its checkpoint, so a stream begun anew does not take the batch numbers of
the old one for its own. A batch costs its own size to apply, a reader folds base and log, and compact() moves the log into
a new base. Nothing that is being read is overwritten, and a base counts only once its commit row
exists, so a job that dies in between leaves the target as it was.

Every change is in the log before it is folded, and the log is kept. So of two bases made at the same time either
may become the current one: what it does not contain is read from the log. Only rebuild() starts a new generation, before
which nothing counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rillway.columns import quoted
from rillway.operators.fold import DATES, SINCE, fold_index, fold_table, outcomes

MERGED = "merge-"        # streams of one batch, written by batch runs


class KeyedTarget:
    def __init__(
        self, spark: SparkSession, path: str, keys: list[str], values: list[str], kind: str = "table",
        pos: str = "pos", op: str = "op", present: str | None = None,
    ):
        if kind not in ("table", "index"):
            raise ValueError(f"unknown target kind {kind!r}")
        self.spark, self.path, self.keys, self.values = spark, path.rstrip("/"), keys, values
        self.kind, self.pos, self.op, self.present = kind, pos, op, present

    def _has_key(self):
        """A row without a value in one of its keys has no place in a target; refused() returns such changes."""
        whole = F.lit(True)
        for k in self.keys:
            whole = whole & quoted(k).isNotNull()
        return whole

    # ---- writing

    def append_batch(self, changes: DataFrame, batch_id: int, stream: str = "main") -> None:
        """Store the changes of one batch of a stream. A repeated batch replaces its earlier attempt."""
        columns = [*self.keys, self.pos, self.op, *self.values, *([self.present] if self.present else [])]
        changes.select(*[quoted(c) for c in columns]).write.mode("overwrite").parquet(
            f"{self.path}/log/log_stream={stream}/log_batch={batch_id}"
        )

    def merge(self, changes: DataFrame) -> None:
        """Apply the changes of a batch run: a stream of one batch, folded at once."""
        stream = MERGED + uuid.uuid4().hex
        self.append_batch(changes, 0, stream)
        self.compact(stream, 0)

    def rebuild(self, rows: DataFrame) -> None:
        """Empty the target and load it again from a snapshot."""
        current = self._committed()
        last = self._last_batches(current)
        state = rows.filter(self._has_key()).select(*[quoted(c) for c in [*self.keys, *self.values]]).withColumns(
            {self.op: F.lit("snapshot"), self.pos: F.lit(-1).cast("bigint")}
        )
        self._commit(state, last, current, new_generation=True)

    def compact(self, stream: str | None = None, batch_id: int | None = None) -> None:
        """Fold the log into a new base. Removed keys stay as delete markers, so that a late repeat of an
        old change cannot bring them back.

        A stream that compacts while others write names itself and its batch: of another stream the last
        batch may be half written, so it is left in the log. Without a stream nobody else may be writing.
        """
        while True:
            current = self._committed()
            last = self._last_batches(current)
            if stream is not None:
                before = current[3]
                last = {s: max(b - 1, before.get(s, -1)) for s, b in last.items() if s != stream}
                last[stream] = max(batch_id, before.get(stream, -1))
            base, log = self._parts(last, current)
            if log is None:
                return
            self._commit(self._fold(base, log, removed=True), last, current)
            if stream is None or self.contains(batch_id, stream):
                return      # else the base of another run was preferred: fold over that one

    def _commit(self, state: DataFrame, last: dict[str, int], current: tuple, new_generation: bool = False) -> None:
        """Write and commit a base made from the current one, in whose generation it counts."""
        generation, version, _, _ = current
        name = f"b{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/base/{name}")
        rows = [(generation + new_generation, version + 1, stream, batch) for stream, batch in (last or {"main": -1}).items()]
        # a folder of its own: jobs that append to one folder at the same time remove each other's files
        self.spark.createDataFrame(rows, "generation bigint, version bigint, stream string, last_batch bigint").coalesce(1).write.parquet(
            f"{self.path}/commits/base={name}"
        )

    # ---- reading

    def read(self) -> DataFrame | None:
        """The rows as of the last batch, or None before the first."""
        base, log = self._parts(None, self._committed())
        return None if base is None and log is None else self._fold(base, log, removed=False)

    def contains(self, batch_id: int, stream: str = "main") -> bool:
        """Whether the batch has been folded into the base, so that it was applied to the end before."""
        return batch_id <= self._committed()[3].get(stream, -1)

    def refused(self, batch_id: int, stream: str = "main") -> DataFrame:
        """Changes of a stored batch the target cannot apply, with a reason: inserts of an existing row
        (table), updates of a missing one (index), changes without a key. They are judged against the batches before it, as
        long as it is not folded. Repeats of applied changes are not refused."""
        same = (F.col("log_stream") == stream) & (F.col("log_batch") == batch_id)
        changes = self._read("log").filter(same).drop("log_stream", "log_batch")
        keyless = changes.filter(~self._has_key()).withColumn("reason", F.lit("null key"))
        changes = changes.filter(self._has_key())
        current = self._committed()
        earlier = {**self._last_batches(current), stream: batch_id - 1}
        touched = changes.select(*[quoted(k) for k in self.keys]).distinct()
        base, log = (None if df is None else df.join(touched, self.keys, "left_semi") for df in self._parts(earlier, current))
        judged = changes
        if base is not None or log is not None:
            state = self._fold(base, log, removed=True).drop(SINCE, DATES)
            seen = state.select(*[quoted(k) for k in self.keys], quoted(self.pos).alias("__seen"))
            fresh = F.col("__seen").isNull() | (quoted(self.pos) > F.col("__seen"))
            judged = changes.join(seen, self.keys, "left").filter(fresh).drop("__seen")
            judged = judged.unionByName(state, allowMissingColumns=True)
        judged = outcomes(judged, self.keys, self.pos, self.op)
        if self.kind == "table":
            failed = F.when(F.col("outcome") == "duplicate", F.lit("duplicate key"))
        else:
            failed = F.when((F.col("outcome") == "no_row") & (quoted(self.op) == "update"), F.lit("document missing"))
        judged = judged.withColumn("reason", failed).filter(F.col("reason").isNotNull()).drop("outcome")
        return judged.unionByName(keyless, allowMissingColumns=True)

    def _fold(self, base: DataFrame | None, log: DataFrame | None, removed: bool) -> DataFrame:
        """Base and log folded. Keys the log does not mention pass by without a shuffle of the base,
        whenever the keys of the log are few enough to be broadcast."""
        fold = fold_table if self.kind == "table" else fold_index
        run = lambda df: fold(df, self.keys, self.values, self.pos, self.op, self.present, removed, dated=removed)
        if base is None:
            return run(log)
        untouched, touched = base, None
        if log is not None:
            keys = log.select(*[quoted(k) for k in self.keys]).distinct()
            untouched = base.join(keys, self.keys, "left_anti")
            touched = run(log.unionByName(base.join(keys, self.keys, "left_semi"), allowMissingColumns=True))
        columns = [*self.keys, *self.values, self.pos, *([self.op, SINCE, DATES] if removed else [])]
        kept = untouched if removed else untouched.filter(quoted(self.op) == "snapshot")
        kept = kept.select(*[quoted(c) for c in columns])
        return kept if touched is None else touched.select(*[quoted(c) for c in columns]).unionByName(kept)

    def _parts(self, up_to: dict[str, int] | None, current: tuple) -> tuple[DataFrame | None, DataFrame | None]:
        """The current base, and the log batches it does not contain, up to a batch of each stream."""
        _, version, name, folded = current
        base = self.spark.read.parquet(f"{self.path}/base/{name}") if version else None
        log = self._read("log")
        if log is not None:
            wanted = F.lit(True)
            for stream, batch in folded.items():
                wanted = wanted & ((F.col("log_stream") != stream) | (F.col("log_batch") > batch))
            if up_to is not None:
                within = F.lit(False)
                for stream, batch in up_to.items():
                    within = within | ((F.col("log_stream") == stream) & (F.col("log_batch") <= batch))
                wanted = wanted & within
            log = log.filter(wanted & self._has_key()).drop("log_stream", "log_batch")
        types = {f.name: f.dataType for part in (log, base) if part is not None for f in part.schema}
        return self._completed(base, types, True), self._completed(log, types, False)

    def _completed(self, stored: DataFrame | None, types: dict, dated: bool) -> DataFrame | None:
        """Columns that the target got after the rows were stored are null in them."""
        if stored is None:
            return None
        late = {v: types.get(v, "string") for v in self.values} | ({SINCE: "bigint", DATES: "map<string,bigint>"} if dated else {})
        late = {c: F.lit(None).cast(t) for c, t in late.items() if c not in stored.columns}
        return stored.withColumns(late) if late else stored

    def _committed(self) -> tuple[int, int, str | None, dict[str, int]]:
        """Generation, version and name of the current base, and the last batch of each stream in it."""
        commits = self._read("commits")
        if commits is None:
            return 0, 0, None, {}
        newest = commits.agg(F.max(F.struct("generation", "version", "base"))).first()[0]
        rows = commits.filter(F.col("base") == newest.base).select("stream", "last_batch").collect()
        return newest.generation, newest.version, newest.base, {r.stream: r.last_batch for r in rows}

    def _last_batches(self, current: tuple | None = None) -> dict[str, int]:
        """The last batch of each stream, in the base or in the log."""
        last = dict((current or self._committed())[3])
        log = self._read("log")
        if log is not None:
            for r in log.groupBy("log_stream").agg(F.max("log_batch").alias("b")).collect():
                last[r.log_stream] = max(int(r.b), last.get(r.log_stream, -1))
        return last

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", part == "log").parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
