"""Sinks: object lines, queue envelopes, index writes, text rendering, routing and discarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from rillway.columns import ALIAS, DOC_SET, ID_VALUE, OP, doc_columns, doc_struct, quoted
from rillway.functions.coerce import is_nested, six_decimals

TARGET = "_target"
TARGET_SET = "_target_set"


def object_lines(df: DataFrame, op: str = OP, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Inserts as one JSON text each (nulls kept), and the rows with other operations, which this
    sink cannot store. keep names columns that stay beside the text."""
    line = F.to_json(doc_struct(df.drop(*keep)), {"ignoreNullFields": "false"}).alias("value")
    return df.filter(quoted(op) == "insert").select(line, *map(quoted, keep)), df.filter(quoted(op) != "insert")


def index_hits(df: DataFrame, index: Column, *keep: str) -> DataFrame:
    """Inserts as hits of an index dump, {"_index", "_id", "_source"}; without an id "_id" is left out."""
    docs = choose_index_id(df.filter(quoted(OP) == "insert")) if ID_VALUE in df.columns else df.filter(quoted(OP) == "insert")
    id_value = quoted(ID_VALUE) if ID_VALUE in docs.columns else F.lit(None).cast("string")
    source = F.to_json(doc_struct(docs.drop(*keep)), {"ignoreNullFields": "false"})
    head = F.struct(index.alias("_index"), id_value.alias("_id"))
    # nulls of the document are kept, a missing id is not written
    text = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"_source":'), source, F.lit("}"))
    return docs.select(text.alias("value"), *map(quoted, keep))


def write_object_lines(df: DataFrame, path: str, op: str = OP) -> DataFrame:
    """Append the inserts as JSON lines; returns the refused rows."""
    lines, refused = object_lines(df, op)
    lines.write.mode("append").text(path)
    return refused


def envelope(df: DataFrame, formatted: bool = True, op: str = OP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Queue messages as JSON text: {"OptionType", "data"}, or the bare document. keep names columns that stay beside it."""
    doc = doc_struct(df.drop(op, *keep))
    body = F.struct(quoted(op).alias("OptionType"), doc.alias("data")) if formatted else doc
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), *map(quoted, keep))


def choose_index_id(df: DataFrame, id_value: str = ID_VALUE) -> DataFrame:
    """The id of an index write: the envelope's id, else the document's _id, which leaves the body.
    Null where there is neither; the index then makes one up."""
    own = F.when(quoted(id_value) != "", quoted(id_value))
    if "_id" not in df.columns:
        return df.withColumn(id_value, own)
    body_id = F.when(quoted("_id") != "", quoted("_id")) if isinstance(df.schema["_id"].dataType, T.StringType) else F.lit(None)
    return df.withColumn(id_value, F.coalesce(own, body_id)).drop("_id")


def render_values(df: DataFrame) -> DataFrame:
    """Values as the text a SQL target stores: floats with six decimals, lists and maps as JSON, nulls kept."""
    return df.select(*[_rendered(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def _rendered(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), six_decimals(c))
    if is_nested(t):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def route(df: DataFrame, targets: list[dict]) -> DataFrame:
    """Add _target and _target_set by alias. targets: [{"id", "document_set": {alias: target set}}], the
    last declaration of an alias winning. An alias that is only named by document set falls back to
    that; a set without a target name keeps its own. _target is null for unrouted rows."""
    by_name: dict[str, tuple[str, str]] = {}
    for t in targets:
        for name, target_set in t["document_set"].items():
            by_name[name] = (t["id"], target_set)
    if not by_name:
        return df.withColumns({TARGET: F.lit(None).cast("string"), TARGET_SET: F.lit(None).cast("string")})
    ids = F.create_map(*[F.lit(x) for n, (i, _) in by_name.items() for x in (n, i)])
    sets = F.create_map(*[F.lit(x) for n, (_, s) in by_name.items() for x in (n, s)])
    look = lambda table: F.coalesce(F.try_element_at(table, quoted(ALIAS)), F.try_element_at(table, quoted(DOC_SET)))
    target_id = look(ids)
    target_set = F.when(target_id.isNotNull(), F.coalesce(F.nullif(look(sets), F.lit("")), quoted(DOC_SET)))
    return df.withColumns({TARGET: target_id, TARGET_SET: target_set})


def discard(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


__all__ = [
    "TARGET", "TARGET_SET", "choose_index_id", "discard", "doc_columns", "envelope", "index_hits", "object_lines",
    "render_values", "route", "write_object_lines",
]
