"""JSON text sources: object lines, queue messages and index hits, with the unusable ones set apart."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from rillway.columns import DOC_SET, ID_FIELD, ID_VALUE, OP, PRESENT, SOURCE_FMT, quoted


class Parsed(NamedTuple):
    docs: DataFrame
    errors: DataFrame


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_object(text: Column, schema: T.StructType) -> Column:
    """The text as a struct if it is exactly one JSON object, else null.

    Parsed as a one-element list: from_json on the bare text would accept a broken tail. The transform
    over a single element names the parsed list, so it is parsed once.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schema))
    return F.transform(F.array(items), lambda parsed: F.when(F.size(parsed) == 1, parsed[0]))[0]


def _once(c: Column) -> Column:
    """The same value, computed where it is selected. Being tied to the partition number keeps the
    optimizer from repeating the parse inside the filters that follow."""
    return F.when(F.spark_partition_id() >= 0, c)


def _errors(df: DataFrame, value: str, reason: Column) -> DataFrame:
    return df.select(
        *[quoted(c) for c in df.columns if c not in (value, "__doc", "__reason", "__msg", PRESENT)],
        reason.alias("reason"),
        quoted(value).alias("body"),
    )


def parse_json_lines(df: DataFrame, schema: str | T.StructType, value: str = "value") -> Parsed:
    """One JSON object per row of a text column; other columns travel along."""
    parsed = df.withColumn("__doc", _once(json_object(quoted(value), _struct(schema))))
    rest = [quoted(c) for c in df.columns if c != value]
    docs = parsed.filter(F.col("__doc").isNotNull()).select(*rest, F.col("__doc.*"))
    return Parsed(docs, _errors(parsed.filter(F.col("__doc").isNull()), value, F.lit("not a json object")))


def parse_queue(df: DataFrame, schema: str | T.StructType, pk: str | None = None, value: str = "value") -> Parsed:
    """Queue messages: {"OptionType": ..., "data": {...}}, or a bare object, which is an insert.

    An envelope with another operation than update and delete is an insert as well. The id is read
    from the document. docs carry the operation, the id and the names of the supplied fields.
    """
    doc_type = _struct(schema)
    envelope = T.StructType([T.StructField("OptionType", T.StringType()), T.StructField("data", doc_type)])
    text = quoted(value)
    message = T.StructType([*doc_type.fields, *envelope.fields])
    parsed = df.withColumns({"__msg": _once(json_object(text, message)), "__keys": _once(F.json_object_keys(text))})
    enveloped = F.array_contains("__keys", "OptionType")
    bare = F.struct(*[F.col(f"__msg.`{f.name}`").alias(f.name) for f in doc_type])
    data_keys = F.json_object_keys(F.get_json_object(text, "$.data"))
    parsed = parsed.withColumns(
        {
            "__doc": F.when(enveloped, F.col("__msg.data")).when(F.col("__msg").isNotNull(), bare),
            PRESENT: F.when(enveloped, data_keys).otherwise(F.col("__keys")),
            "__reason": F.when(F.col("__msg").isNull(), F.lit("bad json"))
            .when(enveloped & ~F.array_contains("__keys", "data"), F.lit("data missing"))
            .when(enveloped & F.col("__msg.data").isNull(), F.lit("data is not an object")),
            OP: F.when(enveloped & F.col("__msg.OptionType").isin("update", "delete"), F.col("__msg.OptionType"))
            .otherwise(F.lit("insert")),
        }
    ).drop("__keys")
    rest = [quoted(c) for c in df.columns if c != value]
    id_value = F.col(f"__doc.`{pk}`").cast("string") if pk else F.lit("")
    docs = parsed.filter(F.col("__reason").isNull()).select(
        *rest, F.col("__doc.*"), OP, PRESENT,
        F.lit(pk or "").alias(ID_FIELD), F.coalesce(id_value, F.lit("")).alias(ID_VALUE), F.lit("NOSQL").alias(SOURCE_FMT),
    )
    return Parsed(docs, _errors(parsed.filter(F.col("__reason").isNotNull()).drop(OP), value, F.col("__reason")))


def parse_index_hits(df: DataFrame, schema: str | T.StructType, value: str = "value") -> Parsed:
    """Hits {"_index", "_id", "_source": {...}} of an index dump as inserts of their index."""
    hit = T.StructType(
        [T.StructField("_index", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("_source", _struct(schema))]
    )
    parsed = df.withColumn("__msg", _once(json_object(quoted(value), hit))).withColumn("__doc", F.col("__msg._source"))
    rest = [quoted(c) for c in df.columns if c != value]
    docs = parsed.filter(F.col("__doc").isNotNull()).select(
        *rest, F.col("__doc.*"),
        F.lit("insert").alias(OP), F.col("__msg._index").alias(DOC_SET),
        F.lit("_id").alias(ID_FIELD), F.col("__msg._id").alias(ID_VALUE), F.lit("NOSQL").alias(SOURCE_FMT),
    )
    return Parsed(docs, _errors(parsed.filter(F.col("__doc").isNull()), value, F.lit("bad hit")))
