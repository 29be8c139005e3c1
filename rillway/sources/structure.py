"""Documents whose structure changes while they arrive: columns come, go, get other names or types without a restart.

A log of such documents is text, one JSON object a line:

    {"pos": 7, "doc": {"id": 1, "total": 9.5}}
    {"pos": 8, "alter": {"rename": {"total": "price"}, "retype": {"price": "decimal(9,2)"}, "drop": ["note"], "add": {"channel": "string"}}}

A document is a VARIANT on its way, so no schema is fixed when a stream starts. The changes make up a list of versions, each named by
the position of its change, and a document has the version in force at its position. It is stored in the typed columns of that version,
in a folder for each version; read_current() reads every folder with its own schema and brings it to the latest structure, so nothing that
is stored is written again, and filters and columns reach the files.

The number of changes is that of statements someone made, and the driver holds them. Documents may arrive in any order of
position, but a change has to arrive no later than the batch of the documents after it, as in a log that is read in order. Parts
of a change that name a column the version lacks, or a name that is taken, have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from rillway.columns import POS, quoted
from rillway.streaming import runner

#: The fields of a line.
LINE = "pos bigint, doc variant, alter struct<rename:map<string,string>,retype:map<string,string>,drop:array<string>,add:map<string,string>>"
FIRST = -1
BATCH = "_batch_id"
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class Version:
    """The columns (name: type) from a position on, and under which name each of them was in the version before."""

    start: int
    columns: dict[str, str]
    before: dict[str, str] = field(default_factory=dict)


def altered(version: Version, start: int, alter: dict) -> Version:
    """The version that a change makes of one: renames, then types, drops, additions."""
    columns = {name: (name, kind) for name, kind in version.columns.items()}
    for old, new in (alter.get("rename") or {}).items():
        if old in columns and new not in columns:
            columns = {new if name == old else name: value for name, value in columns.items()}
    for name, kind in (alter.get("retype") or {}).items():
        if name in columns:
            columns[name] = (columns[name][0], kind)
    for name in alter.get("drop") or []:
        columns.pop(name, None)
    for name, kind in (alter.get("add") or {}).items():
        columns.setdefault(name, (None, kind))
    before = {name: old for name, (old, _) in columns.items() if old is not None}
    return Version(start, {name: kind for name, (_, kind) in columns.items()}, before)


def versions_of(first: dict[str, str], alters: list[tuple[int, dict]]) -> list[Version]:
    """The versions in order. Several changes at one position count as one after the other, under that position."""
    out = [Version(FIRST, dict(first))]
    for pos, alter in sorted(alters, key=lambda x: x[0]):
        last = altered(out[-1], pos, alter)
        if pos == out[-1].start:
            previous = out.pop()
            last = Version(pos, last.columns, {n: previous.before[o] for n, o in last.before.items() if o in previous.before})
        out.append(last)
    return out


def names_in(versions: list[Version], i: int) -> dict[str, str]:
    """Of each column of the last version that version i has as well: its name there."""
    names = {name: name for name in versions[-1].columns}
    for version in reversed(versions[i + 1 :]):
        names = {name: version.before[old] for name, old in names.items() if old in version.before}
    return names


def version_at(pos: Column, versions: list[Version]) -> Column:
    """The start of the version in force at a position, by search in the list of starts."""
    starts = F.array(*[F.lit(v.start).cast("bigint") for v in versions])
    return F.array_max(F.filter(starts, lambda s: (s <= pos) | (s == FIRST)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """value, pos, doc, alter of text lines (value); a line that is no such object has neither doc nor alter."""
    line = F.from_json("value", LINE)
    parsed = lines.select("value", line.alias("line"))
    whole = F.col("line.pos").isNotNull() & (F.col("line.pos") >= 0)
    return parsed.select(
        "value", F.col("line.pos").alias("pos"), F.when(whole, F.col("line.doc")).alias("doc"), F.when(whole, F.col("line.alter")).alias("alter")
    )


def shred(docs: DataFrame, version: Version) -> tuple[DataFrame, DataFrame]:
    """Documents (value, pos, doc) of one version in its typed columns, and those it has no place for: value, pos, reason.

    A field that is absent or null is null. A document with a field the version does not have, or with a value that is not of
    its column's type, is refused whole.
    """
    fields = F.try_variant_get("doc", "$", "map<string,variant>")
    rows = docs.withColumn("__fields", fields)
    known = F.array(*[F.lit(c) for c in version.columns]).cast("array<string>")
    of = lambda name: F.try_element_at("__fields", F.lit(name))
    typed = {f"__{i}": F.try_variant_get(of(name), "$", kind) for i, (name, kind) in enumerate(version.columns.items())}
    rows = rows.withColumns(typed)
    odd = [
        F.when(quoted(key).isNull() & of(name).isNotNull() & ~F.is_variant_null(of(name)), F.lit(f"not a {kind}: {name}"))
        for key, (name, kind) in zip(typed, version.columns.items())
    ]
    unknown = F.array_sort(F.array_except(F.map_keys("__fields"), known))
    reason = F.coalesce(
        F.when(F.col("__fields").isNull(), F.lit("not an object")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(unknown, ", "))),
        *odd, F.lit(None).cast("string"),
    )
    rows = rows.withColumn("__reason", reason)
    good = rows.where("__reason is null").select(F.col("pos").alias(POS), *[quoted(key).alias(name) for key, name in zip(typed, version.columns)])
    return good, rows.where("__reason is not null").select("value", "pos", F.col("__reason").alias("reason"))


def stored_versions(spark: SparkSession, path: str, first: dict[str, str]) -> list[Version]:
    """The versions known to a folder, from the changes that its batches brought."""
    changes = _stored(spark, f"{path}/structure", None)
    rows = [] if changes is None else changes.select("pos", "alter").collect()  # a row per change of structure
    return versions_of(first, [(r.pos, r["alter"].asDict()) for r in rows])


def store_batch(lines: DataFrame, path: str, first: dict[str, str], batch_id: int) -> None:
    """Store the changes, documents and refused lines of one batch. A repeated batch replaces its earlier attempt.

    There is one job for the changes, one to see which versions the documents have, one or two to write each of these, and
    one for lines that cannot be read.
    """
    spark = lines.sparkSession
    parsed = parse_lines(lines).persist()
    try:
        changes = parsed.where("alter is not null").select("pos", "alter")
        # exchanged, since coalesce(1) would have one task read the whole batch for them
        changes.repartition(1).write.mode("overwrite").parquet(f"{path}/structure/{BATCH}={batch_id}")
        versions = stored_versions(spark, path, first)
        at = parsed.where("doc is not null").withColumn("__start", version_at(F.col("pos"), versions))
        refused = parsed.where("doc is null and alter is null").select("value", "pos", F.lit("not a line of the log").alias("reason"))
        present = {r[0] for r in at.select("__start").distinct().collect()}
        for version in (v for v in versions if v.start in present):
            good, odd = shred(at.where(F.col("__start") == version.start).drop("__start"), version)
            good.write.mode("overwrite").parquet(f"{path}/documents/start={version.start}/{BATCH}={batch_id}")
            refused = refused.unionByName(odd)
        refused.write.mode("overwrite").parquet(f"{path}/errors/{BATCH}={batch_id}")
    finally:
        parsed.unpersist()


def read_current(spark: SparkSession, path: str, first: dict[str, str]) -> DataFrame:
    """All stored documents under the latest structure, with their positions.

    Columns that came later are null in older documents, dropped ones are gone, and values are cast where a type has changed (null
    where they do not fit the new one).
    """
    versions = stored_versions(spark, path, first)
    last, out = versions[-1], None
    for i, version in enumerate(versions):
        stored = _stored(spark, f"{path}/documents/start={version.start}", _schema(version))
        if stored is None:
            continue
        names = names_in(versions, i)
        rows = stored.select(POS, *[
            (quoted(names[c]).try_cast(kind) if c in names else F.lit(None).cast(kind)).alias(c) for c, kind in last.columns.items()
        ])
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], _schema(last)) if out is None else out


def refused_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines no version had a place for: value, pos, reason; None before the first batch."""
    return _stored(spark, f"{path}/errors", T.StructType.fromDDL("value string, pos bigint, reason string"))


def start_evolving(
    spark: SparkSession, source: str, path: str, first: dict[str, str], checkpoint: str, files_per_batch: int | None = None, **options
) -> StreamingQuery:
    """Follow the log files of a folder into a folder of documents; the structure may change as it goes."""
    lines = runner.change_stream(spark, source, "value string", files_per_batch, "text")
    return runner.start(lines, lambda batch, batch_id: store_batch(batch, path, first, batch_id), checkpoint, **options)


def _schema(version: Version) -> T.StructType:
    return T.StructType([T.StructField(POS, T.LongType()), *[T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in version.columns.items()]])


def _stored(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in MISSING:
            return None
        raise
