"""Run registered queries next to their SQL counterparts and report differences."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def difference(con: duckdb.DuckDBPyConnection, sql: str, df) -> str | None:
    """None when both hold the same columns and the same rows, repeats included; else a short description."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE expected AS {sql}")
    actual = df.toArrow()
    con.register("actual", actual)
    names = sorted(d[0] for d in con.execute("SELECT * FROM expected LIMIT 0").description)
    if sorted(actual.column_names) != names:
        return f"columns {sorted(actual.column_names)} != {names}"
    columns = ", ".join(f'"{name}"' for name in names)
    left, right = f"SELECT {columns} FROM actual", f"SELECT {columns} FROM expected"
    unlike = []
    for label, one, other in (("only Spark", left, right), ("only SQL", right, left)):
        rows = con.execute(f"SELECT * FROM ({one} EXCEPT ALL {other}) LIMIT 2").fetchall()
        if rows:
            total = con.execute(f"SELECT count(*) FROM ({one} EXCEPT ALL {other})").fetchone()[0]
            unlike.append(f"{label}: {total} rows, {rows}")
    return "; ".join(unlike) or None


def main(folder: str, only: list[str]) -> None:
    import __spark_entry__ as spark_entry
    from tuneledger.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), spark_entry.oracle_sql()
    for name, query in spark_entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            found = difference(con, sql[name], df) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
