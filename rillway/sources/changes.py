"""Change logs: row events, old/new pairs of updates, log headers and column decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.columns import ALIAS, DOC_SET, ID_FIELD, ID_VALUE, OP, POS, SOURCE_FMT, quoted
from rillway.sources.tables import fan_out_aliases

HEADER = "__binLogHeader__"
OLD_DOC = "__oldDoc__"

# Header field order
HEADER_FIELDS = ("Timestamp", "EventType", "ServerID", "EventSize", "LogPos", "Flags")


def change_ops(
    df: DataFrame, doc_set: str, pk: str, pos: str | Column, op: str | Column, aliases: list[str] | None = None
) -> DataFrame:
    """Row changes as envelope rows of a document set, one per alias."""
    pos = quoted(pos) if isinstance(pos, str) else pos
    op = quoted(op) if isinstance(op, str) else op
    out = df.withColumns(
        {
            OP: op, DOC_SET: F.lit(doc_set), SOURCE_FMT: F.lit("SQL"), ID_FIELD: F.lit(pk),
            ID_VALUE: quoted(pk).cast("string"), POS: pos.cast("bigint"),
        }
    )
    return fan_out_aliases(out, aliases or [doc_set])


def pair_updates(rows: DataFrame, event: str, seq: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of update events, which alternate old and new image, as (event, pair, old_doc, doc).

    An event of which an image is missing or there twice is dropped whole; the second frame lists those events. Rows are
    dealt by event once, which serves the pairs and the events.
    """
    image = F.struct(*[quoted(v) for v in values])
    is_old = quoted(seq) % 2 == 0
    pairs = rows.repartition(quoted(event)).groupBy(quoted(event), F.floor(quoted(seq) / 2).alias("pair")).agg(
        F.max(F.when(is_old, image)).alias("old_doc"), F.max(F.when(~is_old, image)).alias("doc"),
        ((F.count(F.when(is_old, 1)) != 1) | (F.count(F.when(~is_old, 1)) != 1)).alias("__half"),
    )
    judged = pairs.withColumn("__half", F.max("__half").over(Window.partitionBy(quoted(event))))
    broken = judged.filter("__half").select(quoted(event)).distinct()
    return judged.filter("not __half").drop("__half"), broken


def delete_images(df: DataFrame, doc: str = "doc", old_doc: str = "old_doc", op: str = OP) -> DataFrame:
    """A delete carries the removed row as document and as old document."""
    return df.withColumn(doc, F.when(quoted(op) == "delete", quoted(old_doc)).otherwise(quoted(doc)))


def with_header(df: DataFrame, fields: dict[str, Column], old_doc: Column | None = None, op: str = OP) -> DataFrame:
    """Add the log header struct, and on updates the old document."""
    missing = [n for n in HEADER_FIELDS if n not in fields]
    if missing:
        raise ValueError(f"header fields missing: {missing}")
    out = df.withColumn(HEADER, F.struct(*[fields[n].cast("bigint").alias(n) if n != "EventType" else fields[n].alias(n) for n in HEADER_FIELDS]))
    if old_doc is not None:
        out = out.withColumn(OLD_DOC, F.when(quoted(op) == "update", old_doc))
    return out


def resume_after(df: DataFrame, saved: int | None, pos: str = POS) -> DataFrame:
    """Changes after the saved position, all of them if nothing was saved. Where the log is kept in files, logs.resume()
    knows whether the position can still be followed."""
    return df if saved is None else df.filter(quoted(pos) > F.lit(saved))


# ---- column decoding -------------------------------------------------------------------------

def decode_enum(index: Column, labels: list[str]) -> Column:
    """Label of a 1-based index, the empty text out of range, null for null."""
    known = F.array(*[F.lit(v) for v in labels])
    i = index.cast("int")
    label = F.when((i > 0) & (i <= len(labels)), F.try_element_at(known, i)).otherwise(F.lit(""))
    return F.when(index.isNotNull(), label)


def decode_set(mask: Column, labels: list[str]) -> Column:
    """Comma list of the labels whose bit is set."""
    if len(labels) > 64:
        raise ValueError("a set has 64 labels at most")
    bits = [F.when(F.getbit(mask.cast("bigint"), F.lit(i)) == 1, F.lit(v)) for i, v in enumerate(labels)]
    return F.when(mask.isNotNull(), F.concat_ws(",", *bits))


def decode_bit(value: Column) -> Column:
    """"1" for the byte 1, "0" for any other text."""
    return F.when(value.isNotNull(), F.when(value == "\x01", F.lit("1")).otherwise(F.lit("0")))


def decode_float(value: Column) -> Column:
    """A float as text of six significant digits, exponents below 1e-4 and from 1e6 up."""
    d = value.cast("double")
    mantissa = F.split(F.format_string("%.5e", d), "e")
    exponent = mantissa[1].cast("int")
    tidy = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    digits = F.greatest(F.lit(0), F.lit(5) - exponent)
    fixed = F.element_at(F.array(*[F.format_string(f"%.{n}f", d) for n in range(10)]), digits + 1)
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    wide = F.concat(tidy(mantissa[0]), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    longer = F.concat(tidy(mantissa[0]), sign, F.abs(exponent).cast("string"))
    return (
        F.when(F.isnan(d), F.lit("NaN"))
        .when(d == float("inf"), F.lit("+Inf")).when(d == float("-inf"), F.lit("-Inf"))
        .when(d == 0, F.lit("0"))
        .when((exponent >= -4) & (exponent < 6), tidy(fixed))
        .when(F.abs(exponent) >= 100, longer)
        .otherwise(wide)
    )
