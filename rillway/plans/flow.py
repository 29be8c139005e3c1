"""An ordered list of steps applied to one document set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.columns import ROOT, doc_columns, quoted
from rillway.operators.relate import find, parse_field_map, relate
from rillway.operators.steps import SpecError, filter_step, map_inline, map_step, split_errors

Lookups = Callable[[str, str], DataFrame]

RELATE_OPTIONS = ("order_by", "unique", "unmatched", "on_missing", "keys_ci", "split_hot", "array_rows", "constant_rows")


def check_steps(steps: list[dict]) -> None:
    """Reject a flow that cannot run, before any data is read."""
    if not steps:
        raise SpecError("flow is empty")
    for i, step in enumerate(steps):
        try:
            _check_step(step)
        except SpecError as e:
            raise SpecError(f"flow step {i}: {e}") from None


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise SpecError(message)


def _check_step(step: dict) -> None:
    kind = step.get("type")
    if kind == "map":
        _require(any(step.get(k) for k in ("set", "drop", "rekey", "fn")), "map does nothing")
    elif kind == "filter":
        _require(step.get("where") is not None and step.get("where") != "", "filter has no predicate")
    elif kind == "mapInline":
        _require(bool(step.get("field_map")), "mapInline needs a field_map")
        for rule in step["field_map"]:
            for key in ("srcField", "srcType", "aimField", "aimType"):
                _require(bool(rule.get(key)), f"mapInline: {key} is empty")
            for key in ("srcType", "aimType"):
                _require(rule[key] in ("long", "float", "string"), f"mapInline: unknown type {rule[key]!r}")
    elif kind == "relateInline":
        _require(step.get("assoc_type") in ("11", "1n"), "assoc_type must be 11 or 1n")
        _require(bool(step.get("relate_document_set")), "relate_document_set is empty")
        _require(step.get("layer_type") in ("sub", "sib"), "layer_type must be sub or sib")
        if step["layer_type"] == "sub":
            _require(bool(step.get("sub_label")), "sub_label is empty")
        else:
            _require(isinstance(step.get("field_map"), dict), "sib needs a field_map")
            parse_field_map(step["field_map"])
        _require(bool(step.get("wheres")), "wheres is empty")
    elif kind == "find":
        _require(bool(step.get("into")) and bool(step.get("wheres")), "find needs into and wheres")
    else:
        raise SpecError(f"unknown step type {kind!r}")


def run_flow(
    df: DataFrame, steps: list[dict], lookups: Lookups, root: list[str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Apply the steps in order. Returns the documents and, if a map checks its numbers, the failed rows.

    root names columns that identify an input row. Without them a flow that multiplies rows and later
    looks up again numbers its input rows, which is repeatable on a file scan.
    """
    fan_outs = [i for i, s in enumerate(steps) if _fans_out(s)]
    checked = any(s.get("check_numbers") for s in steps)
    needs_root = bool(fan_outs) and (checked or any(s.get("assoc_type") == "1n" for s in steps[fan_outs[0] + 1:]))
    numbered = needs_root and root is None
    if numbered:
        df, root = df.withColumn(ROOT, F.monotonically_increasing_id()), [ROOT]
    elif needs_root:
        # the flow may rename or drop the key columns; the root travels in the envelope
        df, root = df.withColumn(ROOT, quoted(root[0]) if len(root) == 1 else F.struct(*map(quoted, root))), [ROOT]
    split = False
    for step in steps:
        df = _run_step(df, step, lookups, root if split else None)
        split = split or _fans_out(step)
    good, failed = split_errors(df, root if needs_root else None)
    return (good.drop(ROOT) if needs_root else good), failed


def _fans_out(step: dict) -> bool:
    return step.get("type") == "relateInline" and step.get("assoc_type") == "1n" and step.get("layer_type") == "sib"


def _run_step(df: DataFrame, step: dict, lookups: Lookups, root: list[str] | None) -> DataFrame:
    kind = step["type"]
    if kind == "map":
        options = {k: step[k] for k in ("set", "drop", "rekey", "fn", "check_numbers") if k in step}
        return map_step(df, **options)
    if kind == "filter":
        return filter_step(df, step["where"])
    if kind == "mapInline":
        return map_inline(df, step["field_map"])
    lookup = lookups(step.get("relate_resource_id", ""), step["relate_document_set"])
    options = {k: step[k] for k in RELATE_OPTIONS if k in step}
    if kind == "find":
        return find(df, lookup, step["into"], step["wheres"], **options)
    return relate(
        df, lookup, step["wheres"], step["assoc_type"], step["layer_type"], step.get("sub_label") or "_sub",
        step.get("field_map"), root=root, **options,
    )


__all__ = ["Lookups", "check_steps", "doc_columns", "run_flow"]
