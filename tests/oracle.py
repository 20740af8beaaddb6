"""Run registered queries against their SQL statements on DuckDB and compare the rows."""
import datetime
import decimal
import math
import os
import time

import duckdb

from filingsift.catalog.views import TABLES


# queries that fit models when they are built; the longest ones run with SLOW_TESTS=1
MODELS = {"i1_topic_vectors", "i2_topic_count_sweep", "i4_weighted_forest", "i5_boosted_trees", "i6_positive_unlabelled", "i7_hidden_positive_sweep",
          "i8_truncated_svd", "i9_isolation_forest", "i10_anomaly_scores", "i14_text_anomaly_job", "i14_vector_anomaly_job", "i14_planted_anomalies", "i15_expanding_evaluation",
          "supervised_topic_job", "supervised_tabular_job"}
SLOW = set() if os.environ.get("SLOW_TESTS") else {"i2_topic_count_sweep", "i7_hidden_positive_sweep", "i14_text_anomaly_job", "supervised_topic_job",
                                                    "supervised_tabular_job"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat() if v.time() != datetime.time() else v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return took, len(got), None
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    duck_took = time.time() - start
    problem = None
    if sorted(names) != sorted(df.columns):
        problem = f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    elif len(got) != len(want):
        problem = f"rows differ: {len(got)} / {len(want)}"
    else:
        for a, b in zip(got, want):
            if a != b and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float))
                                             and float(x) == float(y)) for x, y in zip(a, b)):
                problem = f"values differ: {str(a)[:300]} / {str(b)[:300]}"
                break
    return took, len(got), problem or f"ok (sql {duck_took:.1f}s)"


if __name__ == "__main__":
    import sys
    import traceback
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from filingsift.catalog import registry
    from filingsift.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    modules, prefixes = sys.argv[1].split(","), sys.argv[2:]
    import importlib
    for m in modules:
        if m == "all":
            from filingsift.catalog import load
            load()
        else:
            importlib.import_module(f"filingsift.catalog.{m}")
    session = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    db = duck(sf)
    for q, f in registry.QUERIES.items():
        if prefixes and not any(q.startswith(p) for p in prefixes):
            continue
        try:
            seconds, n, result = compare(session, db, sf, q, f, registry.ORACLES.get(q))
            print(f"{'  ' if result is None or result.startswith('ok') else 'X '}{q:36s} {seconds:6.2f}s {n:7d} rows  {result}", flush=True)
        except Exception as e:
            print(f"X {q:36s} {type(e).__name__}: {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
