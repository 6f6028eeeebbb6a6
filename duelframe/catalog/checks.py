"""Compare registered queries with their SQL on DuckDB: ``python -m duelframe.catalog.checks [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(pdf):
    """Rows as sorted tuples of text, columns in name order."""
    import pandas as pd

    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, float):
            return repr(v + 0.0)
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if hasattr(v, "item"):
            return cell(v.item())
        return str(v)

    return cols, sorted(tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float]:
    from duelframe.catalog import ORACLES, QUERIES

    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()] if name in ORACLES else df.count()
    took = time.time() - t
    if name not in ORACLES:
        return f"rows={rows}", took
    import pandas as pd

    ours_cols = sorted(df.columns)
    ours = canonical(pd.DataFrame([[r[n] for n in df.columns] for r in rows], columns=df.columns, dtype=object))
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]).lower() for d in rel.description}
    alike = {"bigint": "bigint", "integer": "int", "double": "double", "varchar": "string", "boolean": "boolean",
             "date": "date", "timestamp": "timestamp_ntz"}
    odd = {n: (t, kinds.get(n)) for n, t in df.dtypes if alike.get(kinds.get(n)) != t}
    theirs = canonical(pd.DataFrame(rel.fetchall(), columns=names, dtype=object))
    if ours_cols != sorted(names):
        return f"COLUMNS {set(ours_cols) ^ set(names)}", took
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        left, right = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"DIFF rows {len(ours[1])}/{len(theirs[1])} only-spark {len(a - b)}: {ours[0]}\n   {left}\n   {right}", took
    return f"ok rows={len(ours[1])}{f' types {odd}' if odd else ''}", took


def main(sf: str = "0.01", *names: str) -> None:
    import duckdb

    from duelframe.catalog import QUERIES
    from duelframe.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or QUERIES:
        try:
            result, took = compare(spark, con, sf_dir, name)
        except Exception as err:  # report and go on with the next query
            result, took = f"ERROR {type(err).__name__}: {str(err)[:600]}", 0.0
        good = result.startswith(("ok", "rows"))
        bad += not good
        print(f"{'PASS' if good else 'FAIL'} {name} {took:.1f}s {result}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(*sys.argv[1:])
