"""Compare queries with their SQL: ``python -m tests.oracle SF_DIR [name …]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql: str) -> str | None:
    """None if equal, else a short description."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    want = canonical(names, relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    width = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    wrong = [(n, k, types[n]) for n, k in df.dtypes if k in width and width[k] != types[n]]
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        missing = [r for r in want[1] if r not in set(got[1])][:2]
        cut = [tuple(x[:80] for x in r) for r in extra], [tuple(x[:80] for x in r) for r in missing]
        return f"{len(got[1])} rows vs {len(want[1])}; only here {cut[0]}; only there {cut[1]}"
    if wrong:
        return f"types {wrong}"
    if not got[1]:
        return "no rows"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from versemill.session import local_session
    from versemill.staging import scope

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf)
    oracles, failed = oracle_sql(), 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            with scope():
                df = function(spark, sf)
                if name in oracles:
                    found = difference(df, connection, oracles[name])
                else:
                    rows = df.collect()
                    found = None if rows else "no rows"
                    if names:
                        print(*rows[:6], sep="\n")
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
