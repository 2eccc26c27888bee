"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/check_oracles.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive value digest
(doubles at 4 dp), the way the round's correctness gate does.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tracelens.plans import registry  # noqa: E402
from tracelens.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.4f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return norm(list(v))
    if isinstance(v, dict):
        return norm(list(v.values()))
    return str(v)


SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "float": "FLOAT", "timestamp": "TIMESTAMP", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, os_ = registry.queries(), registry.oracles()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in os_:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.execute(os_[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols)
        stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in rel.description}
        tdiff = {c: (stypes.get(c), dtypes.get(c)) for c in stypes if stypes.get(c) != dtypes.get(c)}
        if tdiff:
            print(f"   types differ {name}: {tdiff}")
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = ok and hs == hd
        print(f"{'OK  ' if ok else 'FAIL'} {name}: rows {len(srows)}/{len(drows)} cols {'=' if sorted(scols) == sorted(dcols) else (scols, dcols)} hash {hs}/{hd} {ts:.1f}s")
        if not ok:
            bad += 1
            sl, dl = set(ls), set(ld)
            for x in sorted(sl - dl)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(dl - sl)[:3]:
                print("   duck  only:", x[:300])
    print("failures:", bad)


if __name__ == "__main__":
    main()
