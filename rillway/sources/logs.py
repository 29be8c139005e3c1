"""Logs kept as files: which there are, and whether a saved position can still be followed.

A position is a file and an offset in it. The files of a log differ in the number their names end with, so a shorter name is
the earlier one. The manifest lists every file with its size. A position holds as long as its file is listed and reaches up to
it, whatever gaps the positions of the changes leave. Nothing here runs a job: validity is a subquery of the plan that
needs it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.columns import quoted
from rillway.operators.fold import log_position

FILE, SIZE = "file", "size"
LOST = ("head", "start")


@dataclass(frozen=True)
class Position:
    file: str
    offset: int


def manifest_of(log: DataFrame, file: str = "file", offset: str = "offset") -> DataFrame:
    """The files of a log as far as its changes reach, for logs without a listing of their own."""
    return log.groupBy(quoted(file).alias(FILE)).agg(F.max(quoted(offset)).cast("bigint").alias(SIZE))


def listed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The files of a folder with their sizes, from its listing; their content is not read. Empty files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias(FILE), F.col("length").alias(SIZE))


def ordered(file: Column, offset: Column) -> Column:
    """Positions in log order, for comparisons."""
    return F.struct(F.length(file).alias("digits"), file.alias("file"), offset.cast("bigint").alias("offset"))


def file_position(file: Column, offset: Column) -> Column:
    """The position as one whole number, as the folds want it: the number the file's name ends with, and the offset."""
    number = F.regexp_extract(file, "([0-9]+)$", 1)
    refuse = F.raise_error(F.concat(F.lit("log file without a number: "), F.coalesce(file, F.lit("null")))).cast("bigint")
    return log_position(F.when(number != "", number.cast("bigint")).otherwise(refuse), offset)


def _listed(manifest: DataFrame, saved: Position) -> DataFrame:
    return manifest.filter((quoted(FILE) == saved.file) & (quoted(SIZE) >= saved.offset))


def holds(manifest: DataFrame, saved: Position) -> bool:
    """Whether the position can be followed, asked now."""
    return not _listed(manifest, saved).isEmpty()


def after(saved: Position, file: Column, offset: Column) -> Column:
    longer, same = F.length(file) > len(saved.file), F.length(file) == len(saved.file)
    return longer | (same & ((file > saved.file) | ((file == saved.file) & (offset > saved.offset))))


def resume(
    log: DataFrame, manifest: DataFrame, saved: Position, file: str = "file", offset: str = "offset", lost: str = "head"
) -> DataFrame:
    """The changes after the saved position. If it does not hold, those after the end of the manifest ("head"), or all ("start")."""
    if lost not in LOST:
        raise ValueError(f"lost must be one of {LOST}")
    valid = _listed(manifest, saved).exists()
    later = after(saved, quoted(file), quoted(offset))
    if lost == "start":
        return log.filter(~valid | later)
    end = manifest.agg(F.max(ordered(quoted(FILE), quoted(SIZE)))).scalar()
    beyond = F.coalesce(ordered(quoted(file), quoted(offset)) > end, F.lit(True))
    return log.filter((valid & later) | (~valid & beyond))


def unless_held(snapshot: DataFrame, manifest: DataFrame, saved: Position) -> DataFrame:
    """The snapshot if the saved position does not hold, else no rows."""
    return only_if(snapshot, _listed(manifest, saved).agg(F.count(F.lit(1)).alias("n")).filter("n = 0"))


def only_if(df: DataFrame, asked: DataFrame) -> DataFrame:
    """df if `asked`, a frame of one row at most (a filtered aggregate), has a row; else nothing, without df being read: the
    question is answered first, and adaptive execution drops the scan."""
    return df.join(F.broadcast(asked.select(F.lit(1).alias("__asked"))), F.lit(True), "left_semi")
