"""Runs a registered query and its SQL side by side and compares rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def spark_rows(frame):
    order = sorted(frame.columns)
    return order, Counter(tuple(_plain(r[c]) for c in order) for r in frame.collect())


def duck_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    where = [names.index(c) for c in order]
    return order, Counter(tuple(_plain(row[i]) for i in where) for row in cursor.fetchall())


def difference(frame, folder: str, sql: str) -> str | None:
    s_cols, s_rows = spark_rows(frame)
    d_cols, d_rows = duck_rows(folder, sql)
    if s_cols != d_cols:
        return f"columns {s_cols} against {d_cols}"
    if s_rows != d_rows:
        return (
            f"{sum(s_rows.values())} rows against {sum(d_rows.values())}\n"
            f"only here:  {list((s_rows - d_rows).items())[:3]}\nonly there: {list((d_rows - s_rows).items())[:3]}"
        )
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sessionloom import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            found = (
                difference(query(spark, folder), folder, oracles[name])
                if name in oracles
                else f"no SQL, {query(spark, folder).count()} rows"
            )
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{name:28s} {time.time() - began:6.1f}s {'ok' if found is None else found}", flush=True)
