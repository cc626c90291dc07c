"""A query against its SQL on the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def database(sf: str = SF) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def normal(rows) -> list[str]:
    def cell(v):
        return f"{v:.9g}" if isinstance(v, float) else v

    return sorted(repr([cell(v) for v in r]) for r in rows)


def same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = normal([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()])
    theirs = normal(connection.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({sql})").fetchall())
    assert ours == theirs, (ours[:3], theirs[:3])
