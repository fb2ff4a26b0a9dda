"""Run registered queries against their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return 0.0 if x == 0 else (x if math.isnan(x) else round(x, 6))
    return x


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def compare(spark, con, sf_dir, name, fn, sql) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    mine = [tuple(_cell(r[c]) for c in names) for r in df.collect()]
    if sql is None:
        return None if mine else "no rows"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    order = [cols.index(c) for c in names]
    theirs = [tuple(_cell(r[i]) for i in order) for r in rel.fetchall()]
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    a, b = sorted(mine, key=_key), sorted(theirs, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {str(bad[0])[:600]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from quillrank.plans.catalog import QUERIES, SQL
    from quillrank.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, SQL.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if wanted:
                traceback.print_exc()
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in SQL else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
