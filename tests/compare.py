"""Row-by-row comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


# Spark type -> DuckDB types that hold the same values
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    "float": {"FLOAT"},
}


def differences(spark, con, query, sql, folder):
    """An empty list if names, types and rows agree."""
    df = query(spark, folder)
    names = sorted(df.columns)
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(sql_names) != names:
        return [f"columns {names} against {sorted(sql_names)}"]
    out = []
    kinds = dict(zip(sql_names, [str(d[1]) for d in cur.description]))
    for f in df.schema:
        expected = SAME_TYPE.get(f.dataType.simpleString())
        if expected and kinds[f.name] not in expected:
            out.append(f"type of {f.name}: {f.dataType.simpleString()} against {kinds[f.name]}")
    order = [sql_names.index(n) for n in names]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} against {len(theirs)}")
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        out.append(f"only ours {sorted(a)[:3]}, only theirs {sorted(b)[:3]}")
    return out
