"""Run catalogue queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/check_sql.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def run_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def run_duckdb(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    types = {d[0]: str(d[1]) for d in cursor.description}
    con.close()
    return [columns[i] for i in order], rows, types


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    from tollgate.plans import catalog

    begin = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names, rows = run_spark(df)
    took = time.time() - begin
    if name not in catalog.CHECK_SQL:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    begin = time.time()
    sql_names, sql_rows, types = run_duckdb(catalog.CHECK_SQL[name], sf_dir)
    text = f"{len(rows)} rows, spark {took:.1f}s, sql {time.time() - begin:.1f}s"
    if names != sql_names:
        return False, f"{text}: columns {names} vs {sql_names}"
    if rows != sql_rows:
        ours, theirs = set(rows), set(sql_rows)
        only = sorted(ours - theirs)[:2], sorted(theirs - ours)[:2]
        return False, f"{text}: {len(rows)} vs {len(sql_rows)} rows; only spark {only[0]}; only sql {only[1]}"
    odd = [c for c in schema if schema[c].startswith(("array", "map", "struct", "decimal"))]
    return True, text + (f" (types {schema} / {types})" if odd else "")


def main() -> None:
    from tollgate.plans import catalog
    from tollgate.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf_dir = args[at + 1]
        del args[at : at + 2]
    catalog.load()
    spark = local_session()
    chosen = [n for n in catalog.QUERIES if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in chosen:
        try:
            good, text = compare(spark, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            good, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "BAD ", name, text[:1500], flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
