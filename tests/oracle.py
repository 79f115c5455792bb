"""Comparison of a registered query with its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def rows(frame):
    show = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v
    names = sorted(frame.columns)
    return names, sorted(([show(v) for v in r] for r in frame[names].astype(object).itertuples(index=False)), key=repr)


def check(spark, query, sql):
    connection = duckdb.connect()
    for p in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = query(spark, str(SF)).collect()
    want = connection.execute(sql).fetchall()
    names = [d[0] for d in connection.description]
    assert not got or sorted(got[0].__fields__) == sorted(names)
    show = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    a = sorted((repr([show(r[n]) for n in names]) for r in got))
    b = sorted(repr([show(v) for v in r]) for r in want)
    assert len(a) == len(b)
    assert a == b
