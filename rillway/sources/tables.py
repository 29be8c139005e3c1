"""Snapshot sources: whole tables, pages, several sets at once, generated rows, catalog."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from rillway.columns import ALIAS, DOC_SET, ID_FIELD, ID_VALUE, OP, POS, SOURCE_FMT, quoted
from rillway.functions.coerce import plain_text
from rillway.sources.ranges import KeyRange

FILE_FORMATS = ("parquet", "orc", "json", "csv", "avro", "text")

# Databases left out of an inventory
SYSTEM_DATABASES = ("information_schema", "performance_schema", "mysql")


def read_files(spark: SparkSession, fmt: str, path: str, schema: str | T.StructType | None = None, **options) -> DataFrame:
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unknown file format {fmt!r}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def jdbc_options(
    url: str, table: str, pk: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 32, fetch_rows: int = 10_000, **extra: str,
) -> dict[str, str]:
    """Options of a table read over JDBC: one range of the key per partition, rows fetched in chunks."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **extra}
    if pk is not None and bounds is not None:
        options |= {
            "partitionColumn": pk, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_predicates(ranges: list[KeyRange], key: str) -> list[str]:
    """One predicate per partition; every row satisfies just one of them."""
    return [r.sql(key) for r in ranges]


def read_jdbc(spark: SparkSession, url: str, table: str, pk: str | None = None, partitions: int = 32, ranges: list[KeyRange] | None = None, **extra) -> DataFrame:
    """A table over JDBC. The bounds of a whole-number key are asked of the database, which answers from
    its index; with any other key the table is read in one piece. ranges, from key_ranges() over a column of keys, give one
    partition each instead, for keys of any type."""
    if ranges is not None:
        options = jdbc_options(url, table, **extra)
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(url, table, predicates=jdbc_predicates(ranges, pk), properties=properties)
    bounds = None
    if pk is not None:
        query = f"(SELECT MIN({pk}) AS lo, MAX({pk}) AS hi FROM {table}) b"
        lo, hi = spark.read.format("jdbc").options(**jdbc_options(url, query, **extra)).load().first()
        bounds = (int(lo), int(hi) + 1) if isinstance(lo, (int, Decimal)) else None
    return spark.read.format("jdbc").options(**jdbc_options(url, table, pk, bounds, partitions, **extra)).load()


def snapshot(df: DataFrame, doc_set: str, pk: str | None = None, fmt: str = "SQL") -> DataFrame:
    """Every row as an insert of its document set, with id field and value when the key is known."""
    id_value = quoted(pk).cast("string") if pk else F.lit("")
    return df.withColumns(
        {
            OP: F.lit("insert"), DOC_SET: F.lit(doc_set), ALIAS: F.lit(doc_set), SOURCE_FMT: F.lit(fmt),
            ID_FIELD: F.lit(pk or ""), ID_VALUE: id_value, POS: F.lit(-1).cast("bigint"),
        }
    )


def keyset_page(df: DataFrame, pk: str, after=None, size: int = 100) -> DataFrame:
    """The next page in key order. The key filter reaches the scan and only size rows per task are kept."""
    page = df if after is None else df.filter(quoted(pk) > F.lit(after))
    return page.orderBy(quoted(pk)).limit(size)


def fan_out_aliases(df: DataFrame, aliases: list[str]) -> DataFrame:
    """One copy of each row per alias."""
    if len(aliases) == 1:
        return df.withColumn(ALIAS, F.lit(aliases[0]))
    return df.withColumn(ALIAS, F.explode(F.array(*[F.lit(a) for a in aliases])))


def parse_document_sets(spec: str | dict) -> dict[str, list[str]]:
    """Document set -> aliases, from "a,b" or {"a": "alias", "b": ["x", "y"]}."""
    if isinstance(spec, str):
        return {name: [name] for name in spec.split(",")}
    if isinstance(spec, dict):
        return {name: [a] if isinstance(a, str) else list(a) for name, a in spec.items()}
    raise ValueError("document sets must be a comma list or a mapping")


def multi_source(frames: dict[str, DataFrame], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Several document sets in one frame, tagged; fields a set lacks are null."""
    out = None
    for name, df in frames.items():
        tagged = fan_out_aliases(df.withColumn(DOC_SET, F.lit(name)), (aliases or {}).get(name, [name]))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def stringify(df: DataFrame) -> DataFrame:
    """Every value as text, nulls kept."""
    return df.select(*[plain_text(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def evolve(df: DataFrame, add: dict[str, str] | None = None, rename: dict[str, str] | None = None, drop: list[str] = ()) -> DataFrame:
    """A change of table structure applied to its rows: columns renamed, dropped, added (null, of the given type)."""
    out = df.withColumnsRenamed(rename or {}).drop(*drop)
    return out.withColumns({name: F.lit(None).cast(t) for name, t in (add or {}).items() if name not in out.columns})


def generate(spark: SparkSession, rows: int, fields: int = 10, partitions: int | None = None) -> DataFrame:
    """Rows 1..rows with field0..fieldN equal to the row number and its text as id."""
    numbers = spark.range(1, rows + 1, 1, partitions) if partitions else spark.range(1, rows + 1)
    return _generated(numbers.withColumnRenamed("id", "__n"), fields)


def generate_stream(spark: SparkSession, rows_per_second: int = 1000, fields: int = 10) -> DataFrame:
    """The endless form of generate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _generated(rate.select((F.col("value") + 1).alias("__n")), fields)


def _generated(numbers: DataFrame, fields: int) -> DataFrame:
    values = [F.col("__n").alias(f"field{i}") for i in range(fields)]
    return numbers.select(*values, F.col("__n").cast("string").alias("id"))


def catalog_inventory(spark: SparkSession, frames: dict[str, DataFrame] | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """Database, table, column, type and key of the session catalog, or of the given "db.table" frames."""
    rows = []
    if frames is None:
        names = [
            (d.name, t.name) for d in spark.catalog.listDatabases() if d.name not in SYSTEM_DATABASES
            for t in spark.catalog.listTables(d.name) if not t.isTemporary
        ]
        frames = {f"{d}.{t}": spark.table(f"`{d}`.`{t}`") for d, t in names}
    for name, df in frames.items():
        database, _, table = name.rpartition(".")
        for f in df.schema:
            key = "PRI" if (keys or {}).get(name) == f.name else ""
            rows.append((database, table, f.name, f.dataType.simpleString(), key))
    schema = "database string, table string, field string, type string, key string"
    return spark.createDataFrame(rows, schema)
