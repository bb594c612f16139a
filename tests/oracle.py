"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return x if isinstance(x, (str, bool, type(None))) else str(x)


def _kind(name: str) -> str:
    name = name.upper()
    return {"STRING": "VARCHAR", "INT": "INTEGER", "LONG": "BIGINT"}.get(name, name)


def differences(df, con, sql: str, sizes: list[int] | None = None) -> list[str]:
    """Empty when names, types and the multiset of rows agree. Adds the row count to ``sizes``."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for f in df.schema.fields:
        want, have = _kind(kinds[f.name]), _kind(f.dataType.simpleString())
        if want != have:
            problems.append(f"type of {f.name}: spark {have}, sql {want}")
    order = sorted(names)
    want = Counter(
        tuple(_value(r[names.index(c)]) for c in order) for r in cur.fetchall()
    )
    have = Counter(tuple(_value(r[c]) for c in order) for r in df.collect())
    if sizes is not None:
        sizes.append(sum(have.values()))
    if want != have:
        extra, missing = have - want, want - have
        problems.append(
            f"rows spark {sum(have.values())} sql {sum(want.values())}; columns {order}; "
            f"only spark {list(extra)[:3]}; only sql {list(missing)[:3]}"
        )
    return problems
