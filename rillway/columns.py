"""Names of the envelope columns that travel beside the document's own columns.

A document set is a DataFrame with one column per document field, so filters and column
pruning reach the scan. The envelope is a handful of reserved columns next to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

OP = "_op_type"          # insert | update | delete
DOC_SET = "_doc_set"     # where the row came from
ALIAS = "_alias"         # name under which it is processed
ID_FIELD = "_id_field"
ID_VALUE = "_id_value"
POS = "_pos"             # position in the change log, -1 for snapshot rows
SOURCE_FMT = "_source_fmt"
ERROR = "_error"         # reason why a step failed on this row
ROOT = "_root_id"        # input row a fanned-out row descends from
PRESENT = "_present"     # names of the fields a message supplies: null and absent differ in partial updates

ENVELOPE = (OP, DOC_SET, ALIAS, ID_FIELD, ID_VALUE, POS, SOURCE_FMT, ERROR, ROOT, PRESENT)


def doc_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ENVELOPE]


def envelope_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in ENVELOPE]


def quoted(name: str) -> Column:
    """Column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_map(t: T.DataType) -> bool:
    """Whether values of the type can be neither ordered nor hashed: maps and variants, also inside others."""
    if isinstance(t, T.ArrayType):
        return has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(has_map(f.dataType) for f in t)
    return isinstance(t, (T.MapType, T.VariantType))


def doc_struct(df: DataFrame) -> Column:
    return F.struct(*[quoted(c) for c in doc_columns(df)])


def doc_json(df: DataFrame) -> Column:
    return F.to_json(doc_struct(df), {"ignoreNullFields": "false"})
