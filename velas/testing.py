"""Oracle comparison used by tests and ``scripts/check_oracle.py``.

Runs a Spark DataFrame and a DuckDB SQL text over the same parquet tables and
compares row count, column names and the multiset of rows (exact values,
NULL/NaN normalised, columns in name order).
"""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(row[i]) for i in order) for row in rows], [columns[i] for i in order]


def compare(spark_df, sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    s_norm, s_sorted = rows_of(s_cols, s_rows)
    d_norm, d_sorted = rows_of(d_cols, d_rows)
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "rows_match": len(s_rows) == len(d_rows),
        "schema_match": s_sorted == d_sorted,
    }
    cs, cd = Counter(s_norm), Counter(d_norm)
    out["values_match"] = out["schema_match"] and cs == cd
    if not out["values_match"] and out["schema_match"]:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        # which columns differ (first differing row pair by position in sorted order)
        diffs = Counter()
        for a, b in zip(sorted(cs - cd, key=repr), sorted(cd - cs, key=repr)):
            for name, x, y in zip(s_sorted, a, b):
                if x != y:
                    diffs[name] += 1
        out["differing_columns"] = dict(diffs.most_common(10))
        out["sample_spark_only"] = only_s
        out["sample_oracle_only"] = only_d
    if not out["schema_match"]:
        out["spark_columns"] = s_sorted
        out["oracle_columns"] = d_sorted
    return out
