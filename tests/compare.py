"""A Spark query against its DuckDB SQL over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


SF = "/root/testdata/sf0.001"


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(r[c]) for c in names) for r in frame.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
