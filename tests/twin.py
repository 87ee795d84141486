"""Run registered queries next to their SQL twins in DuckDB and compare the rows.

``python -m tests.twin [name-prefix ...]`` checks at sf0.01, or at $TWIN_SF_DIR.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark_df, con, sql: str) -> str | None:
    cols = sorted(spark_df.columns)
    mine = [tuple(plain(r[c]) for c in cols) for r in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    kinds = dict(zip(names, [str(d[1]) for d in rel.description]))
    huge = [c for c, k in kinds.items() if k in ("HUGEINT", "UBIGINT") or k.startswith("DECIMAL")]
    theirs = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    a, b = Counter(mine), Counter(theirs)
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{len(mine)} rows against {len(theirs)}; only ours {str(left)[:900]}; only SQL {str(right)[:900]}"
    if not mine:
        return "no rows"
    if huge:
        return f"cast these SQL columns: {huge}"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, kinds[c]) for c, t in types.items() if same.get(t, t) != kinds[c] and not kinds[c].startswith("STRING")]
    return f"types differ: {odd}" if odd else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from threadtide.session import local_session

    sf_dir = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf_dir)
    twins = oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in twins:
                word = compare(df, con, twins[name])
            else:
                rows = df.collect()
                word = None if rows else "no rows"
                name += f" (rows only: {len(rows)})"
        except Exception as e:
            word = str(e)[:1500] if not os.environ.get("TWIN_TRACE") else traceback.format_exc()
        bad += word is not None
        print(f"{'ok  ' if word is None else 'FAIL'} {time.time() - start:6.2f}s {name} {word or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
