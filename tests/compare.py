"""Run queries and their SQL checks side by side: python tests/compare.py [sf_dir] [name ...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from joblens.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(rows: list[tuple], columns: list[str]) -> list[tuple]:
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in by_name) for row in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def expected(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), normal(result.fetchall(), columns)


def actual(df) -> tuple[list[str], list[tuple]]:
    rows = [tuple(row) for row in df.collect()]
    return sorted(df.columns), normal(rows, df.columns)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(contract.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    checks = contract.oracle_sql()
    failed = []
    for name in names:
        start = time.time()
        try:
            got = actual(contract.queries()[name](spark, sf_dir))
            seconds = time.time() - start
            want = expected(connection, checks[name]) if name in checks else None
            same = want is None or got == want
            detail = ""
            if not same:
                detail = f"{want[0]} {len(want[1])} rows\n"
                odd = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
                detail += f"   got {got[0]}; first differences {odd}"[:1500]
            verdict = "same" if same and want else "no check" if same else "DIFFERENT"
            print(f"{verdict:10} {name:25} {len(got[1]):8} rows {seconds:6.2f} s {detail}", flush=True)
        except Exception as error:  # noqa: BLE001
            same = False
            print(f"ERROR      {name}: {str(error)[:900]}", flush=True)
        if not same:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
