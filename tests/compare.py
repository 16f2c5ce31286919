"""Side-by-side check of registered queries and their SQL twins."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if x is None:
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, float):
        return (1, repr(round(x, 6)))
    return (1, repr(x))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


# Types the driver may tell apart.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(df, con, sql: str) -> list[str]:
    """Empty where columns, types, row count and all values agree."""
    cur = con.execute(sql)
    sql_types = {c[0]: str(c[1]) for c in cur.description}
    cols, rows = _rows([c[0] for c in cur.description], cur.fetchall())
    got_cols, got_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if got_cols != cols:
        return [f"columns {got_cols} != {cols}"]
    for name, t in df.dtypes:
        if TYPES.get(t, t) != sql_types[name]:
            out.append(f"type of {name}: {t} != {sql_types[name]}")
    if len(got_rows) != len(rows):
        out.append(f"rows {len(got_rows)} != {len(rows)}")
    elif got_rows != rows:
        bad = [(a, b) for a, b in zip(got_rows, rows) if a != b]
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
