"""Compare registered queries with their SQL: python -m tests.parity [sf] [name ...]"""

import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as contract
from workload.views import TABLES

DATA = "/root/testdata"


def oracle_rows(sf: str, sql: str) -> pd.DataFrame:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{sf}/{name}.parquet')")
    return db.execute(sql).df()


def canonical(rows: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return str(v)

    columns = sorted(rows.columns)
    return sorted(tuple(cell(v) for v in row) for row in rows[columns].itertuples(index=False, name=None))


def compare(spark, sf: str, name: str) -> tuple[bool, str]:
    got = contract.queries()[name](spark, f"{DATA}/{sf}").toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    want = oracle_rows(sf, sql)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, f"{len(a)} rows"
    extra, lack = set(a) - set(b), set(b) - set(a)
    return False, f"{len(a)} vs {len(b)} rows; only Spark {list(extra)[:2]}; only SQL {list(lack)[:2]}"


def main(argv: list[str]) -> int:
    from failsift.session import local_session

    sf, names = (argv[0] if argv else "sf0.001"), argv[1:]
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or contract.queries():
        start = time.time()
        try:
            ok, note = compare(spark, sf, name)
        except Exception as error:  # report every key
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {time.time() - start:6.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
