"""A task: where documents come from, the flow of each named set, and where they go.

    {"setup": {...},
     "resource": [{"id": "r1", "type": "parquet", "path": "/data"}],
     "source":   [{"resource_id": "r1", "sync_mode": "direct", "document_set": {"customer": ["c1", "c2"]},
                   "extra": {"pk": "c_custkey"}}],
     "target":   [{"resource_id": "r2", "document_set": {"c1": "customer_copy"}, "extra": {...}}],
     "pipeline": [{"document_set": "c1", "flow": [{"type": "filter", "where": "c_acctbal > 100"}, ...]}]}

Sync modes: direct (snapshot), stream (changes or messages), replica (snapshot, then changes), empty
(the resource is only looked up in). A spec becomes one DataFrame per alias; nothing runs before a
write. The same spec runs as a stream with start_task.

Source extra: pk, pos and op (columns of a change log), changes (document set of the log), log ({"file", "offset"}: columns
that give the positions of a log kept in files, in place of pos, and "manifest": document set that lists its files and sizes),
resume_after (the last position applied, a number or {"file", "offset"}; a replica then skips its snapshot if the log still
reaches back to it), start ("now": a file stream begins with the files that come later; "first", the default: with all),
schema (DDL of JSON documents and of file streams). Target extra: mode, format (queue lines: true enveloped, false bare),
envelope (keep the envelope columns), keyed ("table" or "index": fold into rows) with key.

A target is found by alias, else by document set; without a target name the set is called as the alias or set that was found. A resource of files with
"partitioned": true holds its sets as partitions target=<set> of one folder: all sets that a run writes there are one job, the
aliases of a document set that go there are one stream, and those of them with the same flow are read once. Columns that
only other sets of such a folder have are null; mode overwrite replaces the folder with all its sets.
An index takes hits with the target set as _index, and as _id the id of the document or its field _id.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from rillway.columns import ALIAS, DOC_SET, ID_VALUE, OP, POS, PRESENT, doc_columns, envelope_columns, quoted
from rillway.operators.fold import fold_index, fold_table
from rillway.operators.steps import SpecError
from rillway.plans.flow import check_steps, run_flow
from rillway.sinks.quality import COUNT_SCHEMA, COUNTS, LETTER, count_row, dead_letters, observed, observed_aliases, observed_letters, observed_sets
from rillway.sinks.target import KeyedTarget
from rillway.sinks.writers import TARGET, TARGET_SET, discard, envelope, index_hits, object_lines, route
from rillway.sources import logs
from rillway.sources.changes import change_ops, resume_after
from rillway.sources.messages import parse_index_hits, parse_json_lines, parse_queue
from rillway.sources.tables import FILE_FORMATS, fan_out_aliases, parse_document_sets, read_files, read_jdbc, snapshot
from rillway.streaming import runner

SYNC_MODES = ("direct", "stream", "replica", "empty")
TEXT_TYPES = ("lines", "queue", "index")      # JSON text: object lines, queue messages, index hits
RESOURCE_TYPES = (*FILE_FORMATS, *TEXT_TYPES, "kafka", "jdbc", "table", "empty")
MODES_OF = {"lines": ("direct", "empty"), "index": ("direct", "empty"), "queue": ("stream", "empty"), "kafka": ("stream", "empty")}
TOP_KEYS = ("setup", "resource", "source", "target", "pipeline")

Reader = Callable[[dict, str], DataFrame]


@dataclass
class Task:
    frames: dict[str, DataFrame]                                # alias -> documents after its flow
    outputs: dict[tuple[str, str], DataFrame]                   # (target resource, target set) -> documents
    unrouted: list[str]                                         # aliases without a target
    errors: DataFrame | None                                    # dead letters of sources and flows
    read: dict[str, DataFrame] = field(default_factory=dict)    # alias -> documents before its flow
    counts: dict[str, tuple[Observation, str]] = field(default_factory=dict)    # alias -> rows read, known once its output is written
    shared: dict[str, DataFrame] = field(default_factory=dict)  # partitioned resource -> documents of all its sets, with TARGET_SET


# ---- checks

def load_task(path: str) -> dict:
    """A task spec from a JSON file, checked."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_task(spec)
    return spec


def check_task(spec: dict) -> None:
    """Raise SpecError for a spec that cannot run."""
    for key in spec:
        if key not in TOP_KEYS:
            raise SpecError(f"unknown task section {key!r}")
    for section in ("resource", "source", "target"):
        if not spec.get(section):
            raise SpecError(f"task section {section!r} is missing or empty")
    resources = {r.get("id"): r for r in spec["resource"]}
    for r in spec["resource"]:
        if not r.get("id") or r.get("type") not in RESOURCE_TYPES:
            raise SpecError(f"bad resource {r.get('id')!r} of type {r.get('type')!r}")
    aliases = set()
    for s in spec["source"]:
        aliases |= _check_source(s, resources)
    looked_up = {s["resource_id"] for s in spec["source"]}
    for t in spec["target"]:
        _check_target(t, resources)
    _check_partitioned(spec, resources)
    for p in spec.get("pipeline", []):
        for name in (p.get("document_set") or "").split(","):
            if name not in aliases:
                raise SpecError(f"pipeline document set {name!r} has no source")
        check_steps(p.get("flow") or [])
        for step in p["flow"]:
            lookup = step.get("relate_resource_id")
            if lookup is not None and lookup not in looked_up:
                raise SpecError(f"lookup resource {lookup!r} is not a source")
    _check_cut_arrays(spec)


def _check_cut_arrays(spec: dict) -> None:
    """A document cut into several rows has one key, of which a keyed target would keep the last row only."""
    targets = _targets(spec)
    for p in spec.get("pipeline", []):
        keyed = [n for n in p["document_set"].split(",") if n in targets and (targets[n][0].get("extra") or {}).get("keyed")]
        if keyed and any(step.get("array_rows") is not None for step in p["flow"]):
            raise SpecError(f"array_rows cuts documents into several rows, which the keyed target of {keyed[0]!r} cannot hold")


def _check_source(source: dict, resources: dict) -> set[str]:
    resource = resources.get(source.get("resource_id"))
    if resource is None:
        raise SpecError(f"source resource {source.get('resource_id')!r} is not declared")
    mode = source.get("sync_mode")
    if mode not in MODES_OF.get(resource["type"], SYNC_MODES):
        raise SpecError(f"sync mode {mode!r} is unknown or not for resource type {resource['type']!r}")
    if mode == "empty":
        return set()
    sets = parse_document_sets(source.get("document_set"))
    if not sets or not all(a for names in sets.values() for a in names):
        raise SpecError("source document_set is empty or has an empty alias")
    extra = source.get("extra") or {}
    if (resource["type"] in TEXT_TYPES or resource["type"] == "kafka") and not extra.get("schema"):
        raise SpecError("a source of JSON text needs extra.schema")
    if mode == "replica" and not extra.get("pk"):
        raise SpecError("a replica needs extra.pk")
    _check_position(extra)
    return {a for names in sets.values() for a in names}


def _check_position(extra: dict) -> None:
    log, saved = extra.get("log"), extra.get("resume_after")
    if log is not None and not (isinstance(log, dict) and log.get("file") and log.get("offset")):
        raise SpecError("extra.log names the columns file and offset")
    if isinstance(saved, dict) and not (log and isinstance(saved.get("file"), str) and isinstance(saved.get("offset"), int)):
        raise SpecError("a position of file and offset needs both, and extra.log")
    if log and saved is not None and not isinstance(saved, dict):
        raise SpecError("the position in a log of files is a file and an offset")
    if extra.get("start", "first") not in ("first", "now"):
        raise SpecError(f"unknown start {extra['start']!r}")


def _check_target(target: dict, resources: dict) -> None:
    if target.get("resource_id") not in resources:
        raise SpecError(f"target resource {target.get('resource_id')!r} is not declared")
    if not isinstance(target.get("document_set"), dict) or not target["document_set"]:
        raise SpecError("target document_set must map aliases to target sets")
    extra = target.get("extra") or {}
    if extra.get("keyed") not in (None, "table", "index"):
        raise SpecError(f"unknown keyed target {extra['keyed']!r}")
    if extra.get("keyed") and not extra.get("key"):
        raise SpecError("a keyed target needs extra.key")


def _check_partitioned(spec: dict, resources: dict) -> None:
    """One job writes all sets of a partitioned resource, so they share their options, and their names are names of folders."""
    extras: dict[str, dict] = {}
    for t in spec["target"]:
        resource, extra = resources[t["resource_id"]], t.get("extra") or {}
        if not resource.get("partitioned"):
            continue
        if resource["type"] not in (*FILE_FORMATS, *TEXT_TYPES) or extra.get("keyed"):
            raise SpecError("a partitioned target needs a resource of files and no key")
        if resource.get("suffix"):
            raise SpecError("the sets of a partitioned resource have no suffix")
        if extras.setdefault(t["resource_id"], extra) != extra:
            raise SpecError(f"the targets of partitioned resource {t['resource_id']!r} differ in extra")
        for alias, name in t["document_set"].items():
            if not re.fullmatch(r"[A-Za-z0-9_.-]+", name or alias):
                raise SpecError(f"{name or alias!r} cannot name a partition")


# ---- reading

def default_reader(spark: SparkSession) -> Reader:
    def read(resource: dict, doc_set: str) -> DataFrame:
        kind, options = resource["type"], resource.get("options", {})
        if kind == "table":
            return spark.table(doc_set)
        if kind == "jdbc":
            return read_jdbc(spark, resource["url"], doc_set, resource.get("pk"), **options)
        if kind == "kafka":
            raise SpecError("a kafka source runs with start_task")
        return read_files(spark, "text" if kind in TEXT_TYPES else kind, _place(resource, doc_set), **options)

    return read


def default_stream_reader(spark: SparkSession) -> Callable[[dict, str, dict], DataFrame]:
    def read(resource: dict, doc_set: str, extra: dict) -> DataFrame:
        if resource["type"] == "kafka":
            start = "earliest" if extra.get("resume") else "latest"
            return runner.kafka_stream(spark, resource["servers"], doc_set, start, extra.get("limit"))
        text = resource["type"] in TEXT_TYPES
        fmt, schema = ("text", "value string") if text else (resource["type"], extra["schema"])
        return runner.change_stream(spark, _place(resource, doc_set), schema, extra.get("limit"), fmt)

    return read


def _place(resource: dict, name: str) -> str:
    part = "target=" if resource.get("partitioned") else ""
    return f"{resource['path'].rstrip('/')}/{part}{name}{resource.get('suffix', '')}"


def source_documents(
    raw: DataFrame, resource: dict, source: dict, doc_set: str, aliases: list[str], log: DataFrame | None = None, manifest: DataFrame | None = None,
    held: bool = False,
):
    """One copy of the documents for each alias, and the unreadable rows as dead letters (None if there can be none).
    raw is the snapshot, the change log of a stream, or JSON text; log the change log of a replica, manifest the list of its
    files (taken from the changes themselves where there is none). held: the saved position is known to hold."""
    extra = source.get("extra") or {}
    pk, kind = extra.get("pk"), resource["type"]
    if kind in TEXT_TYPES or kind == "kafka":
        return _text_documents(raw, kind, extra, pk, doc_set, aliases)
    base = None if source["sync_mode"] == "stream" else snapshot(raw, doc_set, pk)
    changes = raw if source["sync_mode"] == "stream" else log
    if changes is not None:
        changes, base = _resumed(changes, base, extra, manifest, held)
        changes = change_ops(changes, doc_set, pk, POS, OP)
        base = changes if base is None else base.unionByName(changes, allowMissingColumns=True)
    return fan_out_aliases(base, aliases), None


def _resumed(changes: DataFrame, base: DataFrame | None, extra: dict, manifest: DataFrame | None, held: bool) -> tuple[DataFrame, DataFrame | None]:
    """The changes after the saved position, with POS and OP, and the snapshot, which is empty if the log reaches back to it."""
    spot, saved = extra.get("log"), extra.get("resume_after")
    changes = changes.withColumnsRenamed({extra.get("op", "op"): OP} | ({} if spot else {extra.get("pos", "pos"): POS}))
    if spot:
        file, offset = spot["file"], spot["offset"]
        position = None if saved is None else logs.Position(saved["file"], saved["offset"])
        if held and position is not None:
            changes = changes.filter(logs.after(position, quoted(file), quoted(offset)))
        elif position is not None:
            manifest = logs.manifest_of(changes, file, offset) if manifest is None else manifest
            # a snapshot taken anew already holds what the log has so far; changes applied twice leave the same rows
            changes = logs.resume(changes, manifest, position, file, offset, "start" if base is not None else "head")
            base = None if base is None else logs.unless_held(base, manifest, position)
        return changes.withColumn(POS, logs.file_position(quoted(file), quoted(offset))).drop(file, offset), base
    if saved is not None and base is not None:
        # numbers alone do not tell a gap from a purged part, so the log has to begin at the position
        first = changes.agg(F.min(quoted(POS)).alias("first"))
        base = logs.only_if(base, first.filter(F.coalesce(F.col("first") > F.lit(saved) + 1, F.lit(True))))
    return resume_after(changes, saved), base


def _text_documents(raw: DataFrame, kind: str, extra: dict, pk: str | None, doc_set: str, aliases: list[str]):
    if kind == "index":
        docs, errors = parse_index_hits(raw, extra["schema"])
    elif kind == "lines":
        docs, errors = parse_json_lines(raw, extra["schema"])
        docs = snapshot(docs, doc_set, pk, "NOSQL")
    else:
        docs, errors = parse_queue(raw, extra["schema"], pk)
        docs = docs.withColumn(DOC_SET, F.lit(doc_set))
    if "pos" in extra and extra["pos"] in docs.columns:
        docs = docs.withColumn(POS, quoted(extra["pos"]).cast("bigint"))
    letters = fan_out_aliases(errors, aliases).select(
        F.lit("read").alias("stage"), "reason", quoted(ALIAS).alias("alias"), F.col("body").alias("doc_json")
    )
    return fan_out_aliases(docs, aliases), letters


def run_alias(docs: DataFrame, flow: list[dict] | None, lookup, pk: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Documents of an alias, or of several with the same flow, after it, and the rows a step failed on as dead letters."""
    if not flow:
        return docs, None
    root = [ID_VALUE, POS, ALIAS] if pk and POS in docs.columns else None
    good, failed = run_flow(docs, flow, lookup, root)
    return good, None if failed is None else dead_letters(failed, "pipeline", F.col("_error"))


def _manifest(reader: Reader, resource: dict, extra: dict) -> DataFrame | None:
    listed = (extra.get("log") or {}).get("manifest")
    return reader(resource, listed) if listed else None


def _flows(spec: dict) -> dict[str, list[dict]]:
    return {name: p["flow"] for p in spec.get("pipeline", []) for name in p["document_set"].split(",")}


def _targets(spec: dict) -> dict[str, tuple[dict, str]]:
    """Where each alias goes: the target that names it, else the one that names its document set; the last one of equals."""
    named = {name: (t, target_set) for t in spec["target"] for name, target_set in t["document_set"].items()}
    found = {}
    for source in (s for s in spec["source"] if s["sync_mode"] != "empty"):
        for doc_set, aliases in parse_document_sets(source["document_set"]).items():
            for alias in aliases:
                name = alias if alias in named else doc_set
                if name in named:
                    found[alias] = (named[name][0], named[name][1] or name)
    return found


def _together(aliases: list[str], targets: dict, resources: dict, flows: dict) -> list[tuple[str | None, list[list[str]]]]:
    """Which aliases of a document set are read and written in one job: those that go to the same partitioned resource,
    in lists with the same flow. Others stand alone, with None for the resource."""
    groups: dict[tuple, dict[str, list[str]]] = {}
    for alias in aliases:
        place = targets[alias][0]["resource_id"] if alias in targets else None
        place = place if place is not None and resources[place].get("partitioned") else None
        same = groups.setdefault((place, alias if place is None else ""), {})
        same.setdefault(json.dumps(flows.get(alias) or [], sort_keys=True, default=id), []).append(alias)
    return [(place, list(same.values())) for (place, _), same in groups.items()]


def _routed(df: DataFrame, aliases: list[str], targets: dict) -> DataFrame:
    """The documents with the target set of their alias."""
    return route(df, [{"id": targets[a][0]["resource_id"], "document_set": {a: targets[a][1]}} for a in aliases]).drop(TARGET)


def _joined(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b, allowMissingColumns=True)


def build_task(spark: SparkSession, spec: dict, reader: Reader | None = None, counted: bool = False) -> Task:
    """Turn a checked spec into DataFrames. counted has the rows of each alias counted by the job that writes it."""
    check_task(spec)
    reader = reader or default_reader(spark)
    resources = {r["id"]: r for r in spec["resource"]}
    lookup = lambda resource_id, doc_set: reader(resources[resource_id], doc_set)
    flows, targets = _flows(spec), _targets(spec)
    task, letters = Task({}, {}, [], None), []

    def add(aliases: list[str], place: str | None, read: Callable, pk: str | None) -> None:
        """Aliases with the same flow, which go to one partitioned resource if there are several."""
        flow, (docs, unread) = flows.get(aliases[0]), read(aliases)
        good, failed = run_alias(docs, flow, lookup, pk)
        letters.extend([unread, failed])
        if counted and aliases[0] in targets:
            # the same flow with its input counted; what fails on the way is counted with the dead letters
            docs, observation = observed_aliases(docs, f"read {' '.join(aliases)}", aliases)
            task.counts.update({alias: (observation, f"rows {i}") for i, alias in enumerate(aliases)})
            good = run_alias(docs, flow, lookup, pk)[0]
        for alias in aliases:
            alone = len(aliases) == 1
            task.read[alias] = docs if alone else docs.filter(quoted(ALIAS) == alias)
            task.frames[alias] = good if alone else good.filter(quoted(ALIAS) == alias)
        if aliases[0] not in targets:
            task.unrouted.extend(aliases)
            return
        target, name = targets[aliases[0]]
        letters.append(_refused_lines(good, resources[target["resource_id"]], target.get("extra") or {}) if counted else None)
        if place is not None:
            task.shared[place] = _joined(task.shared.get(place), _routed(good, aliases, targets))
        else:
            key = (target["resource_id"], name)
            task.outputs[key] = _joined(task.outputs.get(key), good)

    for source in (s for s in spec["source"] if s["sync_mode"] != "empty"):
        resource, extra = resources[source["resource_id"]], source.get("extra") or {}
        for doc_set, names in parse_document_sets(source["document_set"]).items():
            log_set = extra.get("changes", doc_set)
            raw = reader(resource, log_set if source["sync_mode"] == "stream" else doc_set)
            log = reader(resource, log_set) if source["sync_mode"] == "replica" else None
            manifest = _manifest(reader, resource, extra)
            read = lambda aliases: source_documents(raw, resource, source, doc_set, aliases, log, manifest)  # noqa: B023
            for place, lists in _together(names, targets, resources, flows):
                for aliases in lists:
                    add(aliases, place, read, extra.get("pk"))
    task.errors = _all_letters(letters)
    return task


def task_metrics(task: Task) -> DataFrame:
    """Rows read, delivered and failed per alias; filtered rows count as delivered. Rows a source could
    not read are dead letters only."""
    read = None
    for alias, df in task.read.items():
        tagged = df.select(F.lit(alias).alias("alias"))
        read = tagged if read is None else read.unionByName(tagged)
    counts = read.groupBy("alias").agg(F.count(F.lit(1)).alias("full_read_count"))
    if task.errors is None:
        counts = counts.withColumns({"failed_delivery_count": F.lit(0).cast("bigint"), "failed_pipeline_count": F.lit(0).cast("bigint")})
    else:
        failed = task.errors.groupBy("alias").agg(
            F.count_if(F.col("stage") == "delivery").alias("failed_delivery_count"),
            F.count_if(F.col("stage") == "pipeline").alias("failed_pipeline_count"),
        )
        counts = counts.join(failed, "alias", "left").na.fill(0)
    delivered = F.col("full_read_count") - F.col("failed_delivery_count") - F.col("failed_pipeline_count")
    return counts.withColumn("full_delivery_count", delivered)


def _all_letters(letters: list[DataFrame | None]) -> DataFrame | None:
    out = None
    for e in (e for e in letters if e is not None):
        e = e.select(*LETTER)
        out = e if out is None else out.unionByName(e)
    return out


# ---- writing

def target_state(df: DataFrame, kind: str = "table", key: str = ID_VALUE) -> DataFrame:
    """The rows a keyed target holds after the documents, taken as changes in order of position."""
    fold = fold_table if kind == "table" else fold_index
    values = [c for c in doc_columns(df) if c != key]
    return fold(df, [key], values, POS, OP).drop(POS)


def keyed_target(spark: SparkSession, resource: dict, name: str, extra: dict, df: DataFrame) -> KeyedTarget:
    key = extra["key"]
    values = [c for c in doc_columns(df) if c != key]
    present = PRESENT if extra.get("partial") and PRESENT in df.columns else None
    return KeyedTarget(spark, _place(resource, name), [key], values, extra["keyed"], POS, OP, present)


def write_output(df: DataFrame, resource: dict, name: str, extra: dict) -> None:
    """Write documents to one target set."""
    kind, mode = resource["type"], extra.get("mode", "append")
    if extra.get("keyed"):
        target = keyed_target(df.sparkSession, resource, name, extra, df)
        target.rebuild(df) if mode == "overwrite" else target.merge(df)
    elif kind == "empty":
        discard(df)
    elif kind in TEXT_TYPES or kind == "json" or "format" in extra:
        lines = index_hits(df, F.lit(name)) if kind == "index" and "format" not in extra else _lines(df, extra)
        lines.write.mode(mode).text(_place(resource, name))
    elif kind == "kafka":
        _lines(df, {"format": True, **extra}).write.format("kafka").option("kafka.bootstrap.servers", resource["servers"]).option("topic", name).save()
    elif kind == "table":
        _body(df, extra).write.mode(mode).saveAsTable(name)
    elif kind == "jdbc":
        _body(df, extra).write.mode(mode).jdbc(resource["url"], name, properties=resource.get("options", {}))
    else:
        _body(df, extra).write.mode(mode).format(kind).save(_place(resource, name))


def write_partitions(df: DataFrame, resource: dict, extra: dict) -> None:
    """Write documents with TARGET_SET to the sets of a partitioned resource in one job."""
    kind, text = resource["type"], resource["type"] in TEXT_TYPES or resource["type"] == "json" or "format" in extra
    if kind == "index" and "format" not in extra:
        out = index_hits(df, quoted(TARGET_SET), TARGET_SET)
    elif text:
        out = _lines(df, extra, TARGET_SET)
    else:
        out = df if extra.get("envelope") else df.select(*doc_columns(df))
    out = out.withColumnRenamed(TARGET_SET, "target")
    out.write.mode(extra.get("mode", "append")).partitionBy("target").format("text" if text else kind).save(resource["path"].rstrip("/"))


def write_task(task: Task, spec: dict) -> dict[str, dict[str, int]]:
    """Write every output to its target and return the rows (for keyed targets: changes) written."""
    resources = {r["id"]: r for r in spec["resource"]}
    targets = _targets(spec)
    extras = {(t["resource_id"], name): t.get("extra") or {} for t, name in targets.values()}
    written = {}
    for target_id, df in task.shared.items():
        names = sorted({name for t, name in targets.values() if t["resource_id"] == target_id})
        counted, observation = observed_sets(df, target_id, names)
        write_partitions(counted, resources[target_id], next(e for (r, _), e in extras.items() if r == target_id))
        written |= {f"{target_id}/{name}": {"rows": observation.get[f"rows {i}"]} for i, name in enumerate(names)}
    for (target_id, name), df in task.outputs.items():
        # a keyed target stores the changes before it folds them, so they too are counted on their way
        extra = extras[target_id, name]
        counted, observation = observed(df, f"{target_id}/{name}")
        write_output(counted, resources[target_id], name, extra)
        written[f"{target_id}/{name}"] = observation.get
    return written


def run_task(spark: SparkSession, spec: dict, folder: str, reader: Reader | None = None) -> DataFrame:
    """Run the batch part of a task to its end: its outputs, its dead letters (to <folder>/errors) and its counts by alias, which
    are written to <folder>/metrics and returned. There is one job per output and one for the dead letters, if there
    can be any (all sets of a partitioned resource are one output); the counts come from these jobs. Aliases without a target are not read."""
    task = build_task(spark, spec, reader, counted=True)
    write_task(task, spec)
    aliases, failures = list(task.counts), {}
    if task.errors is not None:
        letters, observation = observed_letters(task.errors, "dead letters", aliases)
        letters.write.mode("overwrite").parquet(f"{folder}/errors")
        failures = observation.get
    rows = [
        count_row(alias, task.counts[alias][0].get[task.counts[alias][1]], failures.get(f"delivery {i}", 0), failures.get(f"pipeline {i}", 0))
        for i, alias in enumerate(aliases)
    ]
    spark.createDataFrame(rows, COUNT_SCHEMA).write.mode("overwrite").parquet(f"{folder}/metrics")
    return spark.read.parquet(f"{folder}/metrics")


def stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of a running or ended task by alias, over the batches it has written so far."""
    counts = spark.read.parquet(f"{folder}/metrics")
    return counts.groupBy("alias").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _refused_lines(df: DataFrame, place: dict, extra: dict) -> DataFrame | None:
    """Dead letters of the rows that object lines and hits cannot store, None for targets that take everything."""
    if extra.get("keyed") or not (place["type"] in TEXT_TYPES or place["type"] == "json") or "format" in extra:
        return None
    return dead_letters(object_lines(df)[1], "delivery", "only inserts can be stored")


def _lines(df: DataFrame, extra: dict, *keep: str) -> DataFrame:
    if "format" in extra:
        return envelope(df.drop(*[c for c in envelope_columns(df) if c != OP]), extra["format"], keep=keep)
    return object_lines(df, keep=keep)[0]


def _body(df: DataFrame, extra: dict) -> DataFrame:
    return df if extra.get("envelope") else df.select(*doc_columns(df))


# ---- streaming

def start_task(
    spark: SparkSession, spec: dict, folder: str, reader: Reader | None = None, stream_reader=None, once: bool = False,
    interval: str = runner.FLUSH_INTERVAL,
) -> dict[str, StreamingQuery]:
    """Start the streaming queries of the stream and replica sources, by alias: one for each alias, or for all aliases of a
    document set that go to one partitioned resource. A replica first writes its snapshot to its
    keyed target, once per folder and not at all with resume_after, then follows its change files.

    Lookups are read anew in every micro-batch. Checkpoints and dead letters go to the folder; a batch
    repeated after a failure replaces its dead letters and, in keyed targets, its changes. With
    setup.error_record the rows a target refuses are dead letters too.
    """
    check_task(spec)
    reader = reader or default_reader(spark)
    default_follow = default_stream_reader(spark)
    stream_reader = stream_reader or default_follow
    resources = {r["id"]: r for r in spec["resource"]}
    lookup = lambda resource_id, doc_set: reader(resources[resource_id], doc_set)
    flows, targets, running = _flows(spec), _targets(spec), {}
    for source in (s for s in spec["source"] if s["sync_mode"] in ("stream", "replica")):
        resource, extra = resources[source["resource_id"]], source.get("extra") or {}
        if resource["type"] in ("jdbc", "table") and stream_reader is default_follow:
            raise SpecError(f"a resource of type {resource['type']!r} has no change files to follow")
        for doc_set, names in parse_document_sets(source["document_set"]).items():
            for _, lists in _together(names, targets, resources, flows):
                own = "+".join(alias for aliases in lists for alias in aliases)
                log_set, checkpoint = extra.get("changes", doc_set), f"{folder}/checkpoint/{own}"
                unlimited = lambda: stream_reader(resource, log_set, {**extra, "limit": None})
                resumed = _begin(spark, reader, unlimited, resource, log_set, extra, source["sync_mode"], f"{folder}/start/{own}", checkpoint)
                if source["sync_mode"] == "replica" and not resumed:
                    raw, alias = reader(resource, doc_set), lists[0][0]
                    _load_replica(raw, resource, source, doc_set, alias, flows.get(alias), lookup, targets.get(alias), resources, folder)
                stream = stream_reader(resource, log_set, extra)
                followed = extra if resumed else {k: v for k, v in extra.items() if k != "resume_after"}
                on_batch = _batch_writer(
                    resource, {**source, "sync_mode": "stream", "extra": followed}, doc_set, lists, flows, lookup, targets, resources, folder, checkpoint,
                    bool((spec.get("setup") or {}).get("error_record")),
                )
                query = runner.start(stream, on_batch, checkpoint, once, interval)
                running |= {alias: query for aliases in lists for alias in aliases}
    return running


def _begin(spark, reader, unlimited, resource, log_set, extra, mode, place, checkpoint) -> bool:
    """Where the stream of an alias begins, settled at its first start and written down: whether it goes on from the saved position.

    A position that no longer holds is dropped: the stream then begins now, a replica with a new snapshot. With start "now"
    the files present are passed over before a replica takes its snapshot, so nothing falls between the two.
    """
    try:
        return spark.read.parquet(place).first().resumed
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    saved, spot = extra.get("resume_after"), extra.get("log")
    resumed = saved is not None
    if isinstance(saved, dict):
        manifest = _manifest(reader, resource, extra)
        manifest = logs.manifest_of(reader(resource, log_set), spot["file"], spot["offset"]) if manifest is None else manifest
        resumed = logs.holds(manifest, logs.Position(saved["file"], saved["offset"]))
    lost = saved is not None and not resumed
    if not resumed and (extra.get("start") == "now" or (lost and mode == "stream")) and resource["type"] != "kafka":
        runner.begin_now(unlimited(), checkpoint)
    spark.range(1).select(F.lit(resumed).alias("resumed"), F.current_timestamp().alias("at")).write.parquet(place)
    return resumed


def _load_replica(raw, resource, source, doc_set, alias, flow, lookup, target, resources, folder) -> None:
    """The snapshot of a replica, stored and folded as a stream of one batch; every change has a later position."""
    extra = target[0].get("extra") or {} if target is not None else {}
    if not extra.get("keyed"):
        raise SpecError("a running replica needs a keyed target")
    docs, _ = source_documents(raw, resource, {**source, "sync_mode": "direct"}, doc_set, [alias])
    good, failed = run_alias(docs, flow, lookup, source["extra"]["pk"])
    keyed = keyed_target(raw.sparkSession, resources[target[0]["resource_id"]], target[1], extra, good)
    name = f"snapshot-{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{alias}').hex}"
    if keyed.contains(0, name):
        return
    keyed.append_batch(good, 0, name)
    if failed is not None:
        failed.select(*LETTER).write.mode("overwrite").parquet(f"{folder}/errors/alias={alias}/batch_id=-1")
    keyed.compact(name, 0)


def _store_batch(df: DataFrame, place: str, names: list[str], batch_id: int) -> None:
    """Rows with alias under <place>/alias=.../batch_id=..., in place of those of an earlier try of the batch."""
    if len(names) == 1:
        df.drop("alias").write.mode("overwrite").parquet(f"{place}/alias={names[0]}/batch_id={batch_id}")
        return
    rows = df.withColumn("batch_id", F.lit(batch_id))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("alias", "batch_id").parquet(place)


def _batch_writer(resource, source, doc_set, lists, flows, lookup, targets, resources, folder, checkpoint, record_refused):
    """lists: the aliases of the stream, by flow. Where there are several, they go to one partitioned resource."""
    names = [alias for aliases in lists for alias in aliases]
    target, pk = targets.get(names[0]), (source.get("extra") or {}).get("pk")

    def apply(batch: DataFrame, batch_id: int) -> None:
        letters, keyed, extra, stream, good, counts = [], None, {}, None, None, []
        for i, aliases in enumerate(lists):
            docs, unread = source_documents(batch, resource, source, doc_set, aliases, held=True)
            docs, count = observed_aliases(docs, f"read {names[0]} {i} {batch_id}", aliases)
            part, failed = run_alias(docs, flows.get(aliases[0]), lookup, pk)
            letters += [unread, failed]
            counts += [(alias, count, f"rows {k}") for k, alias in enumerate(aliases)]
            good = _joined(good, part)
        if target is not None:
            place, name, extra = resources[target[0]["resource_id"]], target[1], target[0].get("extra") or {}
            keyed = keyed_target(batch.sparkSession, place, name, extra, good) if extra.get("keyed") else None
            stream = runner.stream_id(batch.sparkSession, checkpoint)
            if keyed is not None and keyed.contains(batch_id, stream):
                return
            if keyed is not None:
                keyed.append_batch(good, batch_id, stream)
            elif place.get("partitioned"):
                write_partitions(_routed(good, names, targets), place, extra)
            else:
                write_output(good, place, name, extra)
            if record_refused:
                letters.append(_refused(good, place, extra, keyed, names[0], batch_id, stream))
        found, failures = _all_letters(letters), {}
        if found is not None:
            found, failed_count = observed_letters(found, f"letters {names[0]} {batch_id}", names)
            _store_batch(found, f"{folder}/errors", names, batch_id)
            failures = failed_count.get
        if target is not None:
            rows = [count_row(alias, count.get[key], failures.get(f"delivery {i}", 0), failures.get(f"pipeline {i}", 0)) for i, (alias, count, key) in enumerate(counts)]
            _store_batch(batch.sparkSession.createDataFrame(rows, COUNT_SCHEMA).coalesce(1), f"{folder}/metrics", names, batch_id)
        every = extra.get("compact_every", 20)
        if keyed is not None and every and batch_id % every == every - 1:
            keyed.compact(stream, batch_id)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # read once: good and unreadable rows are written by different jobs
        batch = batch.persist()
        try:
            apply(batch, batch_id)
        finally:
            batch.unpersist()

    return on_batch


def _refused(good: DataFrame, place: dict, extra: dict, keyed: KeyedTarget | None, alias: str, batch_id: int, stream: str):
    """Dead letters of the rows the target does not take, None for targets that take everything."""
    if keyed is not None:
        refused = keyed.refused(batch_id, stream).withColumnRenamed("reason", "__why").withColumn(ALIAS, F.lit(alias))
        return dead_letters(refused, "delivery", F.col("__why"), "__why")
    return _refused_lines(good, place, extra)
