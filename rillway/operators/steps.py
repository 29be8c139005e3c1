"""The in-row steps of a flow: map, filter, mapInline and document merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from rillway.columns import ERROR, ID_FIELD, ID_VALUE, doc_columns, envelope_columns, quoted
from rillway.functions.coerce import coerce_column, is_nested
from rillway.functions.script import truthy


class SpecError(ValueError):
    """A step that cannot run on these columns."""


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def map_step(
    df: DataFrame,
    set: dict[str, str | Column] | None = None,
    drop: list[str] = (),
    rekey: str | None = None,
    fn: Callable[[DataFrame], DataFrame] | None = None,
    check_numbers: bool = False,
) -> DataFrame:
    """Add or replace fields by SQL expressions over the input row (envelope columns included).

    All expressions see the input, not each other. rekey names the field that becomes the id; the
    id value is taken from it too. fn is any DataFrame -> DataFrame function, for what expressions
    cannot say. With check_numbers a NaN or infinity in a set field marks the row as failed, which
    split_errors takes out.
    """
    if set:
        df_set = {name: _expr(e) for name, e in set.items()}
        df = df.withColumns(df_set)
        if check_numbers:
            df = _mark_bad_numbers(df, list(df_set))
    if fn is not None:
        df = fn(df)
    if rekey is not None:
        if rekey not in df.columns:
            raise SpecError(f"map: id field {rekey!r} does not exist")
        df = df.withColumns({ID_FIELD: F.lit(rekey), ID_VALUE: quoted(rekey).cast("string")})
    return df.drop(*drop) if drop else df


def _mark_bad_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    bad = [n for n in names if isinstance(df.schema[n].dataType, (T.FloatType, T.DoubleType))]
    if not bad:
        return df
    reason = quoted(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
    for n in bad:
        infinite = F.isnan(quoted(n)) | (F.abs(quoted(n)) == float("inf"))
        reason = F.coalesce(reason, F.when(infinite, F.lit(f"map: {n} is not a finite number")))
    return df.withColumn(ERROR, reason)


def filter_step(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Drop the rows for which the predicate is true or truthy. Null keeps the row, and so does a
    struct, map or array, which is no verdict."""
    condition = _expr(predicate)
    kind = df.select(condition.alias("p")).schema[0].dataType
    if is_nested(kind):
        return df
    dropped = truthy(condition, kind)
    if ERROR in df.columns:
        dropped = dropped & quoted(ERROR).isNull()
    return df.filter(~dropped)


def map_inline(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rename and coerce fields: value as srcType, then as aimType, under the name aimField.

    Every rule reads the input row, so names may be swapped. Fields without a rule stay. The last
    rule of a source field counts. Rules for absent fields, or without target name or types, do
    nothing.
    """
    chosen: dict[str, dict] = {}
    for rule in rules:
        if not rule.get("srcField"):
            raise SpecError("mapInline: srcField is empty")
        chosen[rule["srcField"]] = rule
    types = {f.name: f.dataType for f in df.schema}
    produced: dict[str, Column] = {}
    removed = set()
    for source, rule in chosen.items():
        target = rule.get("aimField")
        if source not in types or not (rule.get("srcType") and rule.get("aimType") and target):
            continue
        if target in produced:
            raise SpecError(f"mapInline: two rules write {target!r}")
        try:
            produced[target] = coerce_column(quoted(source), types[source], rule["srcType"], rule["aimType"])
        except ValueError as e:
            raise SpecError(f"mapInline: {e}") from None
        if target != source:
            removed.add(source)
    kept = [quoted(c) if c not in produced else produced[c].alias(c) for c in df.columns if c in produced or c not in removed]
    added = [value.alias(name) for name, value in produced.items() if name not in df.columns]
    return df.select(*kept, *added)


def merge_columns(left: list[str], right: dict[str, Column], matched: Column | None = None) -> list[Column]:
    """Columns of a left document merged with a right one: the right side wins name by name, nulls
    included, where matched holds (always, if None)."""
    out = []
    for name in left:
        if name not in right:
            out.append(quoted(name))
        elif matched is None:
            out.append(right[name].alias(name))
        else:
            out.append(F.when(matched, right[name]).otherwise(quoted(name)).alias(name))
    return out + [value.alias(name) for name, value in right.items() if name not in left]


def merge_maps(*maps: Column) -> Column:
    """Map columns merged, later maps winning key by key, nulls included."""
    merged = maps[0]
    for m in maps[1:]:
        merged = F.map_concat(_without_keys_of(merged, m), m)
    return merged


def _without_keys_of(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _v: ~F.map_contains_key(other, k))


def split_errors(df: DataFrame, root: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Good rows and failed rows. With root columns, a failed row takes all rows of its root along."""
    if ERROR not in df.columns:
        return df, None
    failed = df.filter(quoted(ERROR).isNotNull())
    good = df.filter(quoted(ERROR).isNull()).drop(ERROR)
    if root:
        roots = failed.select(*[quoted(c) for c in root]).distinct()
        good = good.join(roots, root, "left_anti")
        first = F.min(F.struct(ERROR, *[c for c in df.columns if c not in root and c != ERROR])).alias("__row")
        failed = failed.groupBy(*[quoted(c) for c in root]).agg(first).select(*[quoted(c) for c in root], "__row.*")
        failed = failed.select(*[quoted(c) for c in df.columns])
    return good, failed


def keep_envelope(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Replace the document by the given columns and keep the envelope."""
    return df.select(*[quoted(c) for c in envelope_columns(df)], *columns)


__all__ = [
    "SpecError", "doc_columns", "filter_step", "keep_envelope", "map_inline", "map_step",
    "merge_columns", "merge_maps", "split_errors",
]
