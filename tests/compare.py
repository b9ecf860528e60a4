"""Run registered queries beside their SQL in DuckDB and compare the rows.

    python tests/compare.py [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, fn, text: str | None) -> tuple[bool, str]:
    start = time.perf_counter()
    frame = fn(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    seconds = time.perf_counter() - start
    if text is None:
        return len(got) > 0, f"rows only {len(got)} {seconds:.1f}s"
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in frame.dtypes if kinds.get(t, t) != types[c]]
    a, b = _rows(frame.columns, got), _rows(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"rows {len(a)} / {len(b)} differ, e.g. {diff} {odd}"
    return not odd, f"{len(a)} rows {seconds:.1f}s {'TYPES ' + str(odd) if odd else ''}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--rows-only", action="store_true", help="also run queries without SQL")
    parser.add_argument("--conf", action="append", default=[])
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from clickward.plans.queries import oracle_sql, queries
    from clickward.session import build_session

    extra = dict(c.split("=", 1) for c in args.conf)
    spark = build_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.dir)
    texts, bad = oracle_sql(), []
    for name, fn in queries().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        if name not in texts and not args.rows_only and not args.names:
            continue
        try:
            ok, note = compare(spark, con, args.dir, name, fn, texts.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
