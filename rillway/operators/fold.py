"""Ordered change logs folded into the rows that exist after the last change.

A change log is a DataFrame with key columns, an integer position that orders the changes of a
key, an operation (insert, update, delete, or snapshot for a row taken over from an earlier state)
and the image columns. Positions of one key are distinct, except that a change may be repeated.

Both folds are one group-by of max/min aggregates over the whole log. They combine map-side, so
the shuffle carries one row per key and task, and a key with a third of the log costs no more
than any other. Images are structs, so Spark aggregates by sorting each side of the exchange; arrival order
does not matter.

A fold can itself go into a later fold. For that, dated=True adds the columns __since, the order of the insert (or delete)
that a row rests on, and __dates, the orders of the updates on top of it by field ("*": all fields). Changes that come late,
with a position below the row's last one, are then judged as if they had been there before: updates, deletes, and the inserts of
an index. Only a late insert of a table row that lived at the time is taken for a duplicate of the one that was kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.columns import quoted
from rillway.operators.scan import BITS, LEVELS, last_before
from rillway.operators.skew import HOT_ROWS, find_hot_keys

LIVE = "__live"
SINCE, DATES = "__since", "__dates"
ALL_FIELDS = "*"
BEGINNING = -(2**62)     # before every position
OFFSET_BITS = 40
_SALTS = 16       # parts of the second look at re-inserted keys


def log_position(file_no: Column, offset: Column) -> Column:
    """One integer position out of a log file number and an offset below 2^40. A larger or negative offset is an error."""
    number, at = file_no.cast("bigint"), offset.cast("bigint")
    refuse = F.raise_error(F.concat(F.lit("log offset out of range: "), at.cast("string"))).cast("bigint")
    return number * F.lit(2**OFFSET_BITS) + F.when((at < 0) | (at >= 2**OFFSET_BITS), refuse).otherwise(at)


def _order(changes: DataFrame, pos: str, op: str) -> Column:
    """Position doubled, with a snapshot row after the changes it already contains; a dated row where its insert was."""
    order = quoted(pos).cast("bigint") * 2 + F.when(quoted(op) == "snapshot", 1).otherwise(0)
    return F.coalesce(F.col(SINCE), order) if SINCE in changes.columns else order


def _update_order(changes: DataFrame, op: str, field: str) -> Column:
    """The order of the update that a row supplies to a field, null if it supplies none."""
    order = F.when(quoted(op) == "update", F.col("__ord"))
    if DATES not in changes.columns:
        return order
    return F.coalesce(order, F.col(DATES)[field], F.col(DATES)[ALL_FIELDS])


def fold_table(
    changes: DataFrame, keys: list[str], values: list[str], pos: str = "pos", op: str = "op", present: str | None = None,
    removed: bool = False, dated: bool = False,
) -> DataFrame:
    """State of a table with a unique key after the log.

    A row exists if an insert follows the last delete. The first such insert counts, later ones are
    duplicates (see outcomes). Its image is overlaid by the updates after it: by the last one whole,
    or, when present names an array column of the supplied fields, column by column by the last
    update that supplies the column.

    Columns: keys, values, and pos, the position of the last change of the key. With removed=True the
    keys without a row are kept too, and op tells them apart: snapshot for a row, delete for none. dated=True
    adds what a later fold needs to know of both.
    """
    log = changes.withColumn("__ord", _order(changes, pos, op))
    summary = log.groupBy(*[quoted(k) for k in keys]).agg(
        *_common(log, values, pos, op, present),
        F.min_by(_image(values), _order_if(_is_insert(op))).alias("__first"),
        F.min(_order_if(_is_insert(op))).alias("__first_at"),
        F.max(_order_if(_is_insert(op))).alias("__last_at"),
    )
    summary = _living(summary, F.col("__last_at"), removed or dated)
    again = _first_insert_after_delete(log, keys, values, op)
    # inserted, deleted and inserted again: the first insert of all is not the one that counts
    base = summary.join(again, keys, "left").withColumns(
        {
            "__base": F.coalesce(F.col("__again"), F.col("__first")),
            "__base_at": F.coalesce(F.col("__again_at"), F.col("__first_at")),
        }
    )
    return _overlaid(base, keys, values, pos, op, present, removed or dated, dated)


def fold_index(
    changes: DataFrame, keys: list[str], values: list[str], pos: str = "pos", op: str = "op", present: str | None = None,
    removed: bool = False, dated: bool = False,
) -> DataFrame:
    """State of a document index after the log: every insert replaces the whole document, updates
    overlay the fields they supply (all of them without a present column), deletes remove it."""
    log = changes.withColumn("__ord", _order(changes, pos, op))
    summary = log.groupBy(*[quoted(k) for k in keys]).agg(
        *_common(log, values, pos, op, present),
        F.max_by(_image(values), _order_if(_is_insert(op))).alias("__base"),
        F.max(_order_if(_is_insert(op))).alias("__base_at"),
    )
    living = _living(summary, F.col("__base_at"), removed or dated)
    return _overlaid(living, keys, values, pos, op, present, removed or dated, dated)


def _living(summary: DataFrame, last_insert: Column, removed: bool) -> DataFrame:
    live = F.coalesce(last_insert >= F.coalesce(F.col("__gone_at"), F.lit(BEGINNING)), F.lit(False))
    return summary.withColumn(LIVE, live) if removed else summary.filter(live)


def _is_insert(op: str) -> Column:
    return quoted(op).isin("insert", "snapshot")


def _order_if(condition: Column) -> Column:
    """The order of a change, null (and so ignored by min, max, min_by and max_by) unless the condition holds."""
    return F.when(condition, F.col("__ord"))


def _image(values: list[str]) -> Column:
    return F.struct(*[quoted(v) for v in values])


def _gone_at(op: str) -> Column:
    return F.max(_order_if(quoted(op).isin("delete", "snapshot")))


def _common(log: DataFrame, values: list[str], pos: str, op: str, present: str | None) -> list[Column]:
    out = [_gone_at(op).alias("__gone_at"), F.max(quoted(pos)).alias("__pos")]
    if present is None:
        order = _update_order(log, op, ALL_FIELDS)
        return out + [F.max_by(_image(values), order).alias("__update"), F.max(order).alias("__update_at")]
    for i, v in enumerate(values):
        supplied = (quoted(op) != "update") | F.array_contains(quoted(present), v)
        order = F.when(supplied, _update_order(log, op, v))
        dated = F.struct(quoted(v).alias("value"), order.alias("at"))
        out.append(F.max_by(dated, order).alias(f"__u{i}"))
    return out


def _first_insert_after_delete(log: DataFrame, keys: list[str], values: list[str], op: str) -> DataFrame:
    """Image of the first insert after the last delete, for keys with inserts on both sides of it.

    Such keys are few (an id used again). Their inserts are spread over salts, so a hot one is not
    gathered in one task before min_by has reduced it.
    """
    inserts = log.filter(_is_insert(op))
    bounds = (
        log.filter(quoted(op) != "update")
        .groupBy(*[quoted(k) for k in keys])
        .agg(
            _gone_at(op).alias("__gone_at"),
            F.min(_order_if(_is_insert(op))).alias("__first_at"),
            F.max(_order_if(_is_insert(op))).alias("__last_at"),
        )
        .filter((F.col("__first_at") < F.col("__gone_at")) & (F.col("__last_at") >= F.col("__gone_at")))
        .select(*[quoted(k) for k in keys], "__gone_at")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    )
    salted = inserts.withColumn("__salt", F.pmod(F.xxhash64("__ord"), F.lit(_SALTS)).cast("int"))
    partial = (
        salted.join(bounds, [*keys, "__salt"])
        .filter(F.col("__ord") >= F.col("__gone_at"))
        .groupBy(*[quoted(k) for k in keys], "__salt")
        .agg(F.min_by(_image(values), F.col("__ord")).alias("__image"), F.min("__ord").alias("__at"))
    )
    return partial.groupBy(*[quoted(k) for k in keys]).agg(
        F.min_by("__image", "__at").alias("__again"), F.min("__at").alias("__again_at")
    )


def _overlaid(
    base: DataFrame, keys: list[str], values: list[str], pos: str, op: str, present: str | None, removed: bool, dated: bool
) -> DataFrame:
    # a row rests on its insert, a removed one on its delete; updates of a removed row wait for an insert that comes late
    base = base.withColumn("__rests_at", F.coalesce(F.when(F.col(LIVE), F.col("__base_at")), F.col("__gone_at"), F.lit(BEGINNING)) if removed else F.col("__base_at"))
    out, dates = [], []
    for i, v in enumerate(values):
        kept = F.col("__base").getField(v)
        if removed:
            kept = F.when(F.col(LIVE), kept)
        update, at = (F.col("__update").getField(v), F.col("__update_at")) if present is None else (F.col(f"__u{i}").getField("value"), F.col(f"__u{i}").getField("at"))
        newer = at > F.col("__rests_at")
        value = F.when(newer, update).otherwise(kept)
        out.append((F.when(F.col(LIVE), value) if removed and not dated else value).alias(v))
        if present is not None or i == 0:
            dates.append(F.struct(F.lit(v if present is not None else ALL_FIELDS).alias("key"), F.when(newer, at).alias("value")))
    if removed:
        out.append(F.when(F.col(LIVE), F.lit("snapshot")).otherwise(F.lit("delete")).alias(op))
    if dated:
        known = F.filter(F.array(*dates), lambda d: d["value"].isNotNull()) if dates else F.array().cast("array<struct<key:string,value:bigint>>")
        out += [F.col("__rests_at").alias(SINCE), F.map_from_entries(known).alias(DATES)]
    return base.select(*[quoted(k) for k in keys], *out, F.col("__pos").alias(pos))


def split_key_changes(changes: DataFrame, keys: list[str], old_keys: list[str], op: str = "op") -> DataFrame:
    """Updates that change the key as a delete of the old key and an insert of the new one. old_keys name
    the columns with the key before the change; they are dropped."""
    moved = quoted(op) == "update"
    differs = F.lit(False)
    for k, o in zip(keys, old_keys):
        differs = differs | ~quoted(k).eqNullSafe(quoted(o))
    step = lambda kind, names: F.struct(kind.alias("op"), *[quoted(n).alias(f"k{i}") for i, n in enumerate(names)])
    both = F.array(step(F.lit("delete"), old_keys), step(F.lit("insert"), keys))
    steps = F.explode(F.when(moved & differs, both).otherwise(F.array(step(quoted(op), keys))))
    split = changes.withColumn("__step", steps)
    values = {op: F.col("__step.op"), **{k: F.col(f"__step.k{i}") for i, k in enumerate(keys)}}
    return split.withColumns(values).drop("__step", *[o for o in old_keys if o not in keys])


# ---- what became of each change --------------------------------------------------------------

def outcomes(
    changes: DataFrame, keys: list[str], pos: str = "pos", op: str = "op", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The log with a column outcome: applied, duplicate (insert of a living row) or no_row (update or
    delete of a missing one).

    Whether the row is alive depends on the last insert or delete before the change. Within a key this
    is a window; where a key, or the rows without one, have more than hot_rows changes, it is a segmented scan.
    """
    if find_hot_keys(changes, keys, hot_rows):
        return outcomes_scan(changes, keys, pos, op)
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(quoted(pos), quoted(op))
    before = F.last(_alive_after(op), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return changes.withColumn("outcome", _outcome(op, before))


def outcomes_scan(changes: DataFrame, keys: list[str], pos: str = "pos", op: str = "op", bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """outcomes() by a segmented scan, which needs no look at the data beforehand and no task for a whole key."""
    # operations of one position are in alphabetical order, as in the window of outcomes()
    order = quoted(pos).cast("bigint") * 4 + F.array_position(F.array(*[F.lit(o) for o in ("delete", "insert", "snapshot", "update")]), quoted(op)) - 1
    marked = changes.withColumns({"__alive": _alive_after(op), "__ord": order})
    marked = last_before(marked, keys, "__ord", "__alive", "__before", bits, levels)
    return marked.withColumn("outcome", _outcome(op, F.col("__before"))).drop("__alive", "__ord", "__before")


def _alive_after(op: str) -> Column:
    """Whether there is a row after the change, null if the change does not decide it."""
    return F.when(quoted(op).isin("insert", "delete", "snapshot"), quoted(op) != "delete")


def _outcome(op: str, before: Column) -> Column:
    alive = F.coalesce(before, F.lit(False))
    return (
        F.when((quoted(op) == "insert") & alive, F.lit("duplicate"))
        .when(quoted(op).isin("update", "delete") & ~alive, F.lit("no_row"))
        .otherwise(F.lit("applied"))
    )
