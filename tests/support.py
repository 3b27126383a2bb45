"""What several test modules use."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def hours(n: int) -> list[datetime]:
    return [START + timedelta(hours=i) for i in range(n)]


def canonical(columns, rows):
    """Rows with sorted columns, comparable between engines."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def assert_matches_duckdb(query, sql, spark, sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, found.fetchall())
