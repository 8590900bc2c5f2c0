"""Run registered queries next to their SQL twins and compare the results.

    python -m verification.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from verification.oracle import ORACLE_SQL
from verification.queries import QUERIES
from verification.views import TEST_TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TEST_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "null"
        return f"{value + 0.0:.12g}" if value else "0"
    return "null" if value is None else str(value)


def _table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    """Empty text when both results are equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        return "" if got[1] else "no rows"
    result = con.execute(ORACLE_SQL[name])
    want = _table([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if not differing:
        return ""
    g, w = differing[0]
    cells = [f"{c}: {a!r} != {b!r}" for c, a, b in zip(got[0], g, w) if a != b]
    return f"{len(differing)} rows differ, first: {'; '.join(cells)[:600]}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, failed = session(), database(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        failed += bool(problem)
        kind = "ok" if name in ORACLE_SQL else "ok (rows only)"
        print(f"{name}: {problem or kind} [{time.time() - start:.1f}s]", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
