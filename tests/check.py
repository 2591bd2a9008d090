"""Run catalogue queries next to their SQL checks: python tests/check.py [sf] [names...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def table(columns, rows):
    """Columns by name, rows in an order that does not depend on the engine."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)



def differences(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    start = time.time()
    got = table(df.columns, df.collect())
    took = time.time() - start
    start = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = table(columns, rel.fetchall())
    oracle_took = time.time() - start
    problems = []
    if got[0] != want[0]:
        problems.append(f"columns {got[0]} != {want[0]}")
    if len(got[1]) != len(want[1]):
        problems.append(f"rows {len(got[1])} != {len(want[1])}")
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    by_type = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    mine = {f.name: by_type.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {d[0]: str(d[1]) for d in rel.description}
    off = {c: (mine[c], theirs[c]) for c in mine if c in theirs and theirs[c] not in (mine[c], "NUMBER", "STRING", "bool")}
    return len(got[1]), took, oracle_took, problems, off


def main():
    from __spark_entry__ import oracle_sql, queries
    from armlens.session import build

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build("check"), connect(sf_dir)
    all_queries, checks = queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or list(all_queries):
        start = time.time()
        try:
            if name not in checks:
                n = len(all_queries[name](spark, sf_dir).collect())
                print(f"rows-only {name}: {n} rows, {time.time() - start:.2f}s", flush=True)
                continue
            n, took, oracle_took, problems, off = differences(
                spark, con, name, all_queries[name], checks[name], sf_dir
            )
        except Exception as error:  # noqa: BLE001
            n, took, oracle_took, problems, off = 0, 0, 0, [f"{type(error).__name__}: {str(error)[:600]}"], {}
        bad += bool(problems)
        state = "FAIL" if problems else "ok"
        print(f"{state} {name}: {n} rows, {time.time() - start:.2f}s (oracle {oracle_took:.2f}s) {off or ''} {' | '.join(problems)}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
