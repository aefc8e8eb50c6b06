"""Side-by-side run of a query and its SQL statement."""

from __future__ import annotations

import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=_key)


def compare(spark, sf_dir, query, sql, con=None):
    """(problem or None, seconds in Spark, seconds in DuckDB, rows)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    left = rows_of(df.columns, got)
    if sql is None:
        return None, t1 - t0, 0.0, len(got)
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    types = {d[0]: str(d[1]) for d in cur.description}
    right = rows_of([d[0] for d in cur.description], want)
    problem = None
    if left[0] != right[0]:
        problem = f"columns {left[0]} vs {right[0]}"
    elif len(left[1]) != len(right[1]):
        problem = f"rows {len(left[1])} vs {len(right[1])}"
    else:
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        if bad:
            a, b = bad[0]
            cols = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
            problem = f"{len(bad)} rows differ, first: {cols[:4]}"
    spark_types = dict(df.dtypes)
    family = lambda t: "float" if t.lower() in ("double", "float") or t.startswith("decimal") or t.startswith("DECIMAL") else t.lower()
    named = {"bigint": "bigint", "int": "integer", "smallint": "integer", "string": "varchar", "boolean": "boolean"}
    notes = [f"{n}:{t}/{types[n]}" for n, t in spark_types.items() if n in types and named.get(family(t), family(t)) != family(types[n]) and not (family(t) == "float" and types[n] == "DOUBLE")]
    return problem, t1 - t0, t2 - t1, len(got), notes
