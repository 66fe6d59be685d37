"""Runs registered queries next to their oracles: ``python -m workbench.check [sf] [names...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

from workbench.oracles import ORACLES
from workbench.queries import QUERIES
from workbench.session import local_session


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda position: names[position])
    return sorted((tuple(plain(row[position]) for position in order) for row in rows), key=repr)


def connect(sf_dir: str):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def difference(spark, connection, name: str, sf_dir: str) -> str | None:
    df = QUERIES[name](spark, sf_dir)
    got = as_rows(df.columns, [tuple(row) for row in df.collect()])
    if name not in ORACLES:
        return None if got else "no rows"
    result = connection.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected = as_rows(names, result.fetchall())
    if got != expected:
        mine = [row for row in got if row not in expected][:3] if len(got) < 20000 else got[:3]
        theirs = [row for row in expected if row not in got][:3] if len(got) < 20000 else expected[:3]
        return f"{len(got)} against {len(expected)} rows; {sorted(names)}; mine {mine}; oracle {theirs}"
    return None


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - every failure is listed
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "oracle" if name in ORACLES else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name} ({kind}) {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok", flush=True)


if __name__ == "__main__":
    main()
