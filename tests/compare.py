"""Runs registered queries and their SQL side by side. Use: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 9)
    return x


def difference(spark, sf_dir: str, name: str, query, text: str) -> str:
    """Empty if both sides have the same columns and rows."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck(sf_dir).sql(text)
    if sorted(rel.columns) != columns:
        return f"columns {columns} and {sorted(rel.columns)}"
    at = [list(rel.columns).index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first apart: {next(((a, b) for a, b in zip(got, want) if a != b), None)}"
    apart = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(apart)} of {len(got)} rows differ: {str(apart[0])[:600]}" if apart else ""


if __name__ == "__main__":
    import time
    import traceback

    import __spark_entry__ as e
    from lexmill.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("FATAL")
    names = sys.argv[2:] or [k for k in e.queries() if not k.startswith("op") and k != "pipeline"]
    bad = 0
    for name in names:
        began = time.time()
        try:
            text = e.oracle_sql().get(name)
            said = difference(spark, sys.argv[1], name, e.queries()[name], text) if text else f"no SQL, {e.queries()[name](spark, sys.argv[1]).count()} rows"
        except Exception:
            said = "FAILED " + traceback.format_exc(limit=-1)[-900:]
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)
