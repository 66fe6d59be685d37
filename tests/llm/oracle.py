"""Rows of a registered query and of its SQL, side by side."""

from __future__ import annotations

from workbench.check import as_rows, connect

from dataproof.llm.queries import ORACLES, QUERIES


def both(spark, name: str, sf_dir: str):
    df = QUERIES[name](spark, sf_dir)
    result = connect(sf_dir).execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    return as_rows(df.columns, [tuple(row) for row in df.collect()]), as_rows(names, result.fetchall())
