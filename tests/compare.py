"""Compare a query's rows with the rows its SQL gives over the same tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(df, db, sql: str) -> list[str]:
    """What differs, as text; empty when rows, columns and values agree."""
    db.execute(sql)
    names = [d[0] for d in db.description]
    expected_rows = db.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    expected = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in expected_rows)
    actual = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    found = []
    if sum(actual.values()) != sum(expected.values()):
        found.append(f"rows {sum(actual.values())} != {sum(expected.values())}")
    found += [f"only in Spark: {r}"[:400] for r in list((actual - expected).keys())[:3]]
    found += [f"only in SQL:   {r}"[:400] for r in list((expected - actual).keys())[:3]]
    return found
