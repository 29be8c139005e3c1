"""Lookup joins: enrich each document with one or all rows of another document set.

The lookup side is cut to the fields in use, filtered by constant conditions at its scan, and
reduced before the join: one row per key for 1:1, one array per key for nested 1:n. No join
strategy is forced; the optimizer broadcasts a lookup whose size it has checked and shuffles
otherwise. split_hot=True probes the key counts and spreads hot keys of large-by-large joins; a flat
1:n lookup of numbers that have been counted to fit is broadcast then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from rillway.columns import doc_columns, envelope_columns, has_map, quoted
from rillway.functions.coerce import is_fractional, is_integral, plain_text
from rillway.operators.skew import (
    BROADCAST_BYTES, CELL_ROWS, GRID_ROWS, HOT_ROWS, PART, PARTS, all_set, cut_groups, find_hot_keys, grid_join, salted_join, spread,
)
from rillway.operators.steps import SpecError, merge_columns

HIT = "__hit"
ARRAY_PART, ARRAY_PARTS = "__array_part", "__array_parts"
CONSTANT_ROWS = 10_000     # most lookup rows that every main row gets, where no field of it is compared


# ---- conditions ----------------------------------------------------------------------------

def const_text(value) -> str:
    """A constant as condition text: whole floats lose their fraction, other floats have six decimals."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else f"{value:.6f}"
    return str(value)


@dataclass
class Conditions:
    pairs: list[tuple[str, str]]       # main field = lookup field
    constants: list[tuple[str, str]]   # lookup field = text
    empty: bool                        # nothing left to compare: no row matches


def resolve_conditions(wheres: list[dict], columns: list[str], on_missing: str = "error") -> Conditions:
    """Equality conditions of a relate step against the main columns.

    A constant counts only where the main document lacks src_field. With on_missing="truncate" the
    list ends at the first missing field without a constant; by default that is an error. Whatever
    the operator, values are compared for equality; a condition without operator, lookup field or
    something to compare is left out.
    """
    usable = [
        w for w in wheres
        if w.get("rel_field") and w.get("operator") and (w.get("src_field") or w.get("const_value") is not None)
    ]
    if not wheres:
        raise SpecError("relate: wheres is empty")
    pairs, constants = [], []
    for w in usable:
        source, constant = w.get("src_field") or "", const_text(w.get("const_value"))
        if source in columns:
            pairs.append((source, w["rel_field"]))
        elif constant:
            constants.append((w["rel_field"], constant))
        elif on_missing == "truncate":
            break
        else:
            raise SpecError(f"relate: condition field {source!r} does not exist")
    return Conditions(pairs, constants, not pairs and not constants)


def _wide_type(*types: T.DataType) -> str:
    """A type that holds all values of number types exactly; only binary fractions compare as doubles."""
    if all(is_integral(t) for t in types):
        return "bigint"
    if all(is_integral(t) or isinstance(t, T.DecimalType) for t in types):
        # what does not fit beside that many fraction digits equals no value of the type that has them
        return f"decimal(38,{max(t.scale for t in types if isinstance(t, T.DecimalType))})"
    return "double"


def _common_keys(a: Column, ta: T.DataType, b: Column, tb: T.DataType, ignore_case: bool) -> tuple[Column, Column]:
    """Both sides in one type. Text against a number compares as that number; text that is none never matches."""
    if isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        return (F.lower(a), F.lower(b)) if ignore_case else (a, b)
    if ta == tb:
        return a, b
    numeric_a, numeric_b = (is_integral(t) or is_fractional(t) for t in (ta, tb))
    if numeric_a and numeric_b:
        wide = _wide_type(ta, tb)
        return a.try_cast(wide), b.try_cast(wide)
    if numeric_a and isinstance(tb, T.StringType):
        wide = _wide_type(ta)
        return a.cast(wide), b.try_cast(wide)
    if numeric_b and isinstance(ta, T.StringType):
        wide = _wide_type(tb)
        return a.try_cast(wide), b.cast(wide)
    return plain_text(a, ta), plain_text(b, tb)


# ---- field maps ------------------------------------------------------------------------------

@dataclass
class Mapped:
    side: str              # "r" lookup, "s" main
    field: str
    name: str
    default: Column | None = None
    default_text: bool = False


def _number_or(text: str, convert, zero):
    try:
        return convert(text)
    except ValueError:
        return zero


def _default(kind: str, text: str) -> tuple[Column | None, bool]:
    if kind == "d" and text == "now":
        return F.unix_timestamp(), False
    if kind in ("d", "i"):
        return F.lit(_number_or(text, int, 0)).cast("bigint"), False
    if kind == "f":
        return F.lit(_number_or(text, float, 0.0)), False
    if kind in ("s", "str"):
        return F.lit(text), True
    return None, False


def parse_field_map(field_map: dict[str, str]) -> list[Mapped]:
    """{"r.x": "name|type:default", "s.y": "name"}: r. is the lookup side, any other prefix or none the
    main side, names with two dots or more are ignored. Types: i, f, s/str, d (epoch or "now")."""
    out = []
    for origin, target in field_map.items():
        path = origin.split(".")
        options = target.split("|")
        default, is_text = None, False
        if len(options) == 2:
            kind = options[1].split(":")
            if len(kind) != 2:
                raise SpecError(f"relate: bad default in {target!r}")
            default, is_text = _default(*kind)
        if len(path) <= 2:
            side = "r" if len(path) == 2 and path[0] == "r" else "s"
            out.append(Mapped(side, path[-1], options[0], default, is_text))
    return out


def _with_default(value: Column, t: T.DataType, m: Mapped) -> tuple[Column, T.DataType]:
    if m.default is None:
        return value, t
    numeric = is_integral(t) or is_fractional(t)
    if m.default_text and not isinstance(t, T.StringType):
        return F.coalesce(plain_text(value, t), m.default), T.StringType()
    if not m.default_text and not numeric:
        return F.coalesce(plain_text(value, t), m.default.cast("string")), T.StringType()
    return F.coalesce(value, m.default), t


def _either(condition: Column, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, T.DataType]:
    """when(condition, a).otherwise(b), as text where the two types have no common one."""
    numeric = all(is_integral(t) or is_fractional(t) for t in (ta, tb))
    if ta != tb and not numeric:
        a, b, ta = plain_text(a, ta), plain_text(b, tb), T.StringType()
    return F.when(condition, a).otherwise(b), ta


def _mapped_values(
    mapped: list[Mapped], main: DataFrame, lookup: DataFrame, hit: Column
) -> dict[str, tuple[Column, T.DataType]]:
    """Target name -> value of a field-mapped document. On one name the lookup wins if it has the field."""
    out: dict[str, tuple[Column, T.DataType]] = {}
    main_types = {f.name: f.dataType for f in main.schema}
    lookup_types = {f.name: f.dataType for f in lookup.schema}
    for m in (m for m in mapped if m.side == "s"):
        if m.field in main_types:
            out[m.name] = _with_default(quoted(m.field), main_types[m.field], m)
        elif m.default is not None:
            out[m.name] = (m.default, T.StringType() if m.default_text else T.LongType())
    for m in (m for m in mapped if m.side == "r"):
        if m.field in lookup_types:
            value, t = _with_default(quoted("__r_" + m.field), lookup_types[m.field], m)
            if m.name in out and m.default is None:
                value, t = _either(hit, value, t, *out[m.name])
            out[m.name] = (value, t)
        elif m.default is not None:
            out[m.name] = (m.default, T.StringType() if m.default_text else T.LongType())
    return out


# ---- the step --------------------------------------------------------------------------------

def relate(
    main: DataFrame,
    lookup: DataFrame,
    wheres: list[dict],
    assoc: str = "11",
    layer: str = "sub",
    sub_label: str = "_sub",
    field_map: dict[str, str] | None = None,
    order_by: list[str] | None = None,
    unique: bool = False,
    unmatched: str = "passthrough",
    root: list[str] | None = None,
    on_missing: str = "error",
    keys_ci: bool = False,
    split_hot: bool | int = False,
    array_rows: int | None = None,
    constant_rows: int = CONSTANT_ROWS,
) -> DataFrame:
    """Join each main row with its first ("11") or all ("1n") matching lookup rows.

    layer="sub" nests the match under sub_label: a struct (all fields null without a match, which
    prints as {}) or an array. layer="sib" puts it beside the main fields: field_map=None merges all
    fields with the lookup winning, a map keeps only the mapped fields, {} changes nothing but the
    row count.

    1:1 takes the first row by order_by, ties broken by the fields in use; unique=True promises one
    row per key and saves that aggregation. 1:n rows without a match pass through unmapped
    ("passthrough"), are dropped ("drop") or pass with nulls ("nulls"). With root columns, a row
    without a match is dropped when another row of the same root has one. A nested array longer than
    array_rows is cut: its document then comes out in several rows, which hold every match between them.

    split_hot=True spreads keys with very many rows, a number says from how many rows on. Where constants are all there is to
    compare, every main row meets the same lookup rows. They are found once, as a value of the plan; 1:n gives an error
    if there are more than constant_rows.
    """
    if assoc not in ("11", "1n") or layer not in ("sub", "sib"):
        raise SpecError(f"relate: unknown assoc {assoc!r} or layer {layer!r}")
    conditions = resolve_conditions(wheres, main.columns, on_missing)
    mapped = parse_field_map(field_map) if layer == "sib" and field_map else []
    if layer == "sib" and field_map == {}:
        fields = []
    elif layer == "sib" and mapped:
        fields = [c for c in dict.fromkeys(m.field for m in mapped if m.side == "r") if c in lookup.columns]
    else:
        fields = lookup.columns
    if assoc == "11" and layer == "sib" and field_map == {}:
        return main

    left, right, keys = _key_columns(main, lookup, conditions, fields, order_by or [], keys_ci)
    hit = F.coalesce(F.col(HIT), F.lit(False))
    if not conditions.pairs:
        joined = _with_first(left, right, fields, order_by or []) if assoc == "11" else _with_all(left, right, fields, layer, constant_rows)
        if assoc == "11":
            return joined.select(*_one_row_output(main, lookup, layer, sub_label, field_map, mapped, hit))
        joined = joined.filter(hit) if unmatched == "drop" else joined
        return joined.select(*_many_rows_output(main, lookup, layer, sub_label, field_map, mapped, hit, unmatched))
    if assoc == "11":
        right = right if unique else _first_per_key(right, keys, fields, order_by or [])
        joined = _join(left, right.withColumn(HIT, F.lit(True)), keys, "left", split_hot, cut_right=False)
        return joined.select(*_one_row_output(main, lookup, layer, sub_label, field_map, mapped, hit))

    if layer == "sub":
        right = _nest(right, keys, fields, sub_label, array_rows)
    how = "inner" if unmatched == "drop" and not root else "left"
    joined = _join(left, right.withColumn(HIT, F.lit(True)), keys, how, split_hot, cut_right=layer == "sib")
    if root:
        joined = _drop_unmatched_siblings(joined, left, right, keys, root, unmatched, split_hot)
    out = _many_rows_output(main, lookup, layer, sub_label, field_map, mapped, hit, unmatched)
    if layer == "sub" and array_rows is not None:
        numbers = {f"{sub_label}_part": F.coalesce(F.col(ARRAY_PART), F.lit(0)), f"{sub_label}_parts": F.coalesce(F.col(ARRAY_PARTS), F.lit(1))}
        clash = [c for c in numbers if c in main.columns]
        if clash:
            raise SpecError(f"relate: array_rows adds {clash[0]!r}, which the documents have already")
        out = [*out, *[number.cast("bigint").alias(name) for name, number in numbers.items()]]
    return joined.select(*out)


def find(main: DataFrame, lookup: DataFrame, into: str, wheres: list[dict], **options) -> DataFrame:
    """Point lookup of one row per document, as a struct under into; null where nothing matches."""
    hit_name = "__found"
    marked = lookup.withColumn(hit_name, F.lit(True))
    out = relate(main, marked, wheres, "11", "sub", into, **options)
    found = F.struct(*[F.col(f"`{into}`.`{c}`").alias(c) for c in lookup.columns])
    return out.withColumn(into, F.when(F.col(f"`{into}`.{hit_name}"), found))


def _key_columns(main, lookup, conditions: Conditions, fields, order_by, keys_ci):
    """Main with __k columns, and the lookup as (__k..., __r_<field>..., __o_<order>...)."""
    main_types = {f.name: f.dataType for f in main.schema}
    types = {f.name: f.dataType for f in lookup.schema}
    for name in [r for _, r in conditions.pairs] + [r for r, _ in conditions.constants]:
        if name not in types:
            raise SpecError(f"relate: lookup field {name!r} does not exist")
    for name, text in conditions.constants:
        value = F.lit(text) if isinstance(types[name], T.StringType) else F.lit(text).try_cast(types[name])
        lookup = lookup.filter(quoted(name) == value)
    if conditions.empty:
        lookup = lookup.limit(0)
    left_keys, right_keys = [], []
    for i, (source, rel) in enumerate(conditions.pairs):
        a, b = _common_keys(quoted(source), main_types[source], quoted(rel), types[rel], keys_ci)
        left_keys.append(a.alias(f"__k{i}"))
        right_keys.append(b.alias(f"__k{i}"))
    keys = [f"__k{i}" for i in range(len(left_keys))]
    left = main.select(*[quoted(c) for c in main.columns], *left_keys)
    right = lookup.select(
        *right_keys,
        *[quoted(c).alias("__r_" + c) for c in fields],
        *[quoted(c).alias("__o_" + c) for c in order_by],
    )
    return left, right, keys


def _first_per_key(right: DataFrame, keys, fields, order_by) -> DataFrame:
    """One lookup row per key. min over a struct combines map-side, so a hot key costs one row per task."""
    first = _first_of(right, fields, order_by)
    if first is None:
        return right.select(*keys).distinct()
    return (
        right.groupBy(*keys).agg(first.alias("__first"))
        .select(*keys, *[F.col(f"__first.`__r_{c}`").alias("__r_" + c) for c in fields])
    )


def _first_of(right: DataFrame, fields, order_by) -> Column | None:
    """The aggregate of the first row, None if no field is in use."""
    types = {f.name: f.dataType for f in right.schema}
    rank = ["__o_" + c for c in order_by] + ["__r_" + c for c in fields]
    sortable = [quoted(c) for c in rank if not has_map(types[c])]
    rest = [quoted(c) for c in rank if has_map(types[c])]
    if rest and not sortable:
        raise SpecError("relate: these fields have no order, order_by is needed")
    if rest:
        return F.min_by(F.struct(*sortable, *rest), F.struct(*sortable))
    return F.min(F.struct(*sortable)) if sortable else None


def _with_first(main: DataFrame, right: DataFrame, fields, order_by) -> DataFrame:
    """main beside the first of the lookup rows, which is one value for the whole plan."""
    first = _first_of(right, fields, order_by)
    one = right.agg(F.count(F.lit(1)).alias("__n"), *([] if first is None else [first.alias("__first")]))
    found = main.withColumn("__one", one.select(F.struct("*")).scalar())
    return found.select(
        *[quoted(c) for c in main.columns], (F.col("__one.__n") > 0).alias(HIT),
        *[F.col(f"__one.__first.`__r_{c}`").alias("__r_" + c) for c in fields],
    )


def _with_all(main: DataFrame, right: DataFrame, fields, layer: str, most: int) -> DataFrame:
    """main with all lookup rows, as an array (sub) or one row each (sib). They are a value of the plan, so their number is checked."""
    item = F.struct(F.lit(True).alias(HIT), *[quoted("__r_" + c).alias(c) for c in fields])
    items = F.collect_list(item)
    if not has_map(right.select(item.alias("i")).schema[0].dataType):
        items = F.sort_array(items)
    too_many = F.raise_error(F.lit(f"relate: constants alone match more than {most} rows, see constant_rows"))
    found = F.when(F.count(F.lit(1)) > most, too_many).otherwise(items).alias("__all")
    joined = main.withColumn("__all", right.limit(most + 1).agg(found).scalar())
    if layer == "sub":
        nested = F.transform("__all", lambda x: F.struct(*[x.getField(c).alias(c) for c in fields]))
        return joined.withColumns({HIT: F.size("__all") > 0, "__items": F.when(F.size("__all") > 0, nested)}).drop("__all")
    each = joined.withColumn("__one", F.explode_outer("__all")).drop("__all")
    return each.select(
        *[quoted(c) for c in main.columns], F.col(f"__one.{HIT}").alias(HIT), *[F.col("__one").getField(c).alias("__r_" + c) for c in fields]
    )


def _nest(right: DataFrame, keys, fields, label, array_rows) -> DataFrame:
    """One sorted array of matches per key, cut into several rows beyond array_rows."""
    item = F.struct(*[quoted("__r_" + c).alias(c) for c in fields])
    items = F.collect_list(item)
    kinds = right.select(item.alias("i")).schema[0].dataType
    if not has_map(kinds):
        items = F.sort_array(items)
    group = list(keys)
    if array_rows is not None:
        cut = cut_groups(right.filter(all_set(keys)), keys, array_rows)
        # names of their own, since a join with hot keys spread has a __part as well
        right = cut.withColumnsRenamed({PART: ARRAY_PART, PARTS: ARRAY_PARTS})
        group += [ARRAY_PART, ARRAY_PARTS]
    # partial arrays before the shuffle would save nothing: rows go over as they are and are listed once
    return right.repartition(*group).groupBy(*group).agg(items.alias("__items"))


def _join(left: DataFrame, right: DataFrame, keys, how, split_hot, cut_right) -> DataFrame:
    if not split_hot:
        return left.join(right, keys, how)
    given = None if split_hot is True else int(split_hot)
    if not cut_right:
        return salted_join(left, right, keys, how, find_hot_keys(left, keys, given or HOT_ROWS), given or HOT_ROWS)
    return grid_join(left, right, keys, how, HIT, given or GRID_ROWS, given or HOT_ROWS, given * given if given else CELL_ROWS, BROADCAST_BYTES)


def _drop_unmatched_siblings(joined, left, right, keys, root, unmatched, split_hot) -> DataFrame:
    """Drop unmatched rows whose root has a match elsewhere. Rows without a root have no siblings.

    The rows of a root meet in one window, so the flow up to here runs once. With split_hot a root may have more rows than a
    task should see: then the roots with a match are found from the key columns, distinct map-side, and joined to the
    rows with hot roots spread; for that the flow runs twice.
    """
    hit = F.coalesce(F.col(HIT), F.lit(False))
    if not split_hot:
        rooted = all_set(root)
        alone = F.when(~rooted, spread(joined, F.lit(1 << 20)))
        matched = F.max(hit).over(Window.partitionBy(*[quoted(r) for r in root], alone)) & rooted
        flagged = joined.withColumn("__any", matched)
        return flagged.filter(hit if unmatched == "drop" else hit | ~F.col("__any"))
    names = [f"__root{i}" for i in range(len(root))]
    matched_roots = (
        left.join(right.select(*keys).distinct(), keys, "left_semi")
        .select(*[quoted(r).alias(n) for r, n in zip(root, names)])
        .distinct()
        .withColumn("__any", F.lit(True))
    )
    named = joined.withColumns({n: quoted(r) for r, n in zip(root, names)})
    given = HOT_ROWS if split_hot is True else int(split_hot)
    flagged = salted_join(named, matched_roots, names, "left", find_hot_keys(named, names, given), given).drop(*names)
    return flagged.filter(hit if unmatched == "drop" else hit | F.col("__any").isNull())


def _lookup_struct(lookup: DataFrame) -> Column:
    return F.struct(*[quoted("__r_" + c).alias(c) for c in lookup.columns])


def _merged(main: DataFrame, lookup: DataFrame, hit: Column) -> list[Column]:
    types = {f.name: f.dataType for f in main.schema}
    right = {}
    for f in lookup.schema:
        value = quoted("__r_" + f.name)
        if f.name in types:
            value = _either(hit, value, f.dataType, quoted(f.name), types[f.name])[0]
        right[f.name] = value
    return merge_columns(main.columns, right)


def _labelled(main: DataFrame, label: str, value: Column) -> list[Column]:
    return [*[quoted(c) for c in main.columns if c != label], value.alias(label)]


def _one_row_output(main, lookup, layer, label, field_map, mapped, hit) -> list[Column]:
    if layer == "sub":
        return _labelled(main, label, _lookup_struct(lookup))
    if field_map is None:
        return _merged(main, lookup, hit)
    values = _mapped_values(mapped, main, lookup, hit)
    return [*[quoted(c) for c in envelope_columns(main)], *[v.alias(n) for n, (v, _) in values.items()]]


def _many_rows_output(main, lookup, layer, label, field_map, mapped, hit, unmatched) -> list[Column]:
    if layer == "sub":
        return _labelled(main, label, F.col("__items"))
    if field_map is None:
        return _merged(main, lookup, hit)
    if not field_map:
        return [quoted(c) for c in main.columns]
    values = _mapped_values(mapped, main, lookup, hit)
    envelope = [quoted(c) for c in envelope_columns(main)]
    if unmatched != "passthrough":
        return [*envelope, *[v.alias(n) for n, (v, _) in values.items()]]
    # one schema for both kinds of rows: matched ones carry the mapped fields, the others the main ones
    types = {f.name: f.dataType for f in main.schema}
    out = []
    for c in doc_columns(main):
        if c in values:
            out.append(_either(hit, *values[c], quoted(c), types[c])[0].alias(c))
        else:
            out.append(F.when(~hit, quoted(c)).alias(c))
    out += [F.when(hit, v).alias(n) for n, (v, _) in values.items() if n not in types]
    return [*envelope, *out]
