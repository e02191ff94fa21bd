"""Run queries next to their SQL: python tests/compare.py SF_DIR [NAME...]"""

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None, ""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return len(got), True, ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return len(got), False, f"{len(got)}/{len(want)} rows; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pairloom.session import get_spark

    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, sqls, con = entry.queries(), entry.oracle_sql(), duck(sys.argv[1])
    bad = 0
    for name in [q for q in queries if not names or any(q.startswith(n) for n in names)]:
        t = time.time()
        try:
            n, same, why = compare(spark, con, queries[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            n, same, why = -1, False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += same is False
        print(f"{'ok ' if same else 'ROWS' if same is None else 'BAD'} {name} {n} rows {time.time() - t:.1f}s {why}", flush=True)
    sys.exit(bad)
