"""Run a registered query and its SQL twin side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()], key=_key)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_key)


SAME = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def type_gaps(df, con, sql):
    """Columns whose types are not each other's twin."""
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (ours.get(c), theirs.get(c)) for c in set(ours) | set(theirs) if SAME.get(theirs.get(c)) != ours.get(c)}
