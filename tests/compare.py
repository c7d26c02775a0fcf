"""Compare a Spark query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value: object) -> object:
    return round(value, 9) if isinstance(value, float) else value


def difference(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """Why the two results differ, or None."""
    names = sorted(frame.columns)
    cursor = connection.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns {names} against {sorted(found)}"
    kinds = dict(frame.dtypes)
    other = {d[0]: str(d[1]).upper() for d in cursor.description}
    same = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [n for n in names if same.get(kinds[n], kinds[n]) != other[n]]
    order = [found.index(n) for n in names]
    right = sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    left = sorted((tuple(_plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows against {len(right)}; {names}; {only_left} / {only_right}"
    if wrong:
        return "types " + ", ".join(f"{n}: {kinds[n]} against {other[n]}" for n in wrong)
    return None
