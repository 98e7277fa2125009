"""Run the registered queries against their SQL twins and report differences.

``python -m checks.compare [folder] [name-prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pyarrow as pa

from checks import load_all
from cohortry.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(table: pa.Table) -> list[tuple]:
    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted((tuple(_cell(v) for v in row) for row in zip(*columns, strict=True)), key=repr)


def _close(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b, strict=True):
        if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
            if abs(x - y) > 2e-5 * max(1.0, abs(x)):
                return False
        elif x != y:
            return False
    return True


def compare(spark, folder: str, name: str, query, sql: str | None) -> tuple[str, float]:
    start = time.time()
    mine = query(spark, folder)
    got = mine.toArrow()
    took = time.time() - start
    if sql is None:
        return (f"rows {got.num_rows}", took)
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    relation = db.execute(sql)
    want = relation.to_arrow_table()
    types = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(got.column_names) != sorted(want.column_names):
        return (f"COLUMNS {sorted(got.column_names)} vs {sorted(want.column_names)}", took)
    spark_types = dict(mine.dtypes)
    odd = [
        f"{c}: {spark_types[c]} vs {types[c]}"
        for c in got.column_names
        if _kind(spark_types[c]) != _kind(types[c].lower())
    ]
    note = f" TYPES {odd}" if odd else ""
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return (f"ROWCOUNT {len(a)} vs {len(b)}{note}", took)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if all(_close(x, y) for x, y in bad):
            return (f"ok ({len(a)} rows, rounding differs in {len(bad)}){note}", took)
        return (f"VALUES {len(bad)} differ, first {bad[0]}{note}", took)
    return (f"ok ({len(a)} rows){note}", took)


def _kind(t: str) -> str:
    for key, kind in (
        ("bigint", "long"), ("hugeint", "huge"), ("decimal", "decimal"), ("int", "int"), ("double", "double"),
        ("float", "float"), ("string", "string"), ("varchar", "string"), ("bool", "bool"), ("timestamp", "ts"),
        ("datetime", "ts"), ("date", "date"), ("number", "?"),
    ):
        if t.startswith(key):
            return kind
    return t


def main() -> None:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    prefixes = tuple(args[1:]) or ("",)
    queries, oracles = load_all()
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, query in queries.items():
        if not name.startswith(prefixes):
            continue
        try:
            verdict, took = compare(spark, folder, name, query, oracles.get(name))
        except Exception as error:  # report every failure, not only the first
            verdict, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0
        good = verdict.startswith(("ok", "rows"))
        failed += not good
        print(f"{'' if good else '!! '}{name} {took:.1f}s {verdict}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
