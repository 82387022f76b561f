"""Run queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagewatch.catalog.oracle import ORACLES  # noqa: E402
from pagewatch.catalog.queries import QUERIES  # noqa: E402
from pagewatch.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    if name not in ORACLES:
        return f"rows only ({len(got)})", seconds
    result = con.sql(ORACLES[name])
    want = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(result.columns)}", seconds
    if got != want:
        missing = [r for r in want if r not in set(got)][:2]
        extra = [r for r in got if r not in set(want)][:2]
        return f"ROWS {len(got)} vs {len(want)}\n   want {missing}\n   got  {extra}", seconds
    kinds = {f: t.simpleString() for f, t in zip(df.columns, [x.dataType for x in df.schema])}
    other = {c: str(t) for c, t in zip(result.columns, result.types)}
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP"}
    odd = {c: (k, other[c]) for c, k in kinds.items() if names.get(k) != other[c]}
    return f"ok {len(got)}" + (f" types {odd}" if odd else ""), seconds


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            text, seconds = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on with the next query
            text, seconds = f"ERROR {str(error)[:600]}", 0.0
            if "-v" in args.names:
                traceback.print_exc()
        bad += not text.startswith(("ok", "rows"))
        print(f"{name:36s} {seconds:6.1f}s  {text}", flush=True)
    print(f"{bad} failed; {sorted(set(ORACLES) - set(QUERIES))} without a query")


if __name__ == "__main__":
    main()
