"""Run registered queries against their SQL; usage: check_oracle.py SF_DIR [name ...]"""

import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    out = []
    for r in frame[cols].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else (float(v) if isinstance(v, float) else v if isinstance(v, (str, bool)) else float(v)) for v in r))
    return cols, sorted(out, key=repr)


def compare(df, con, sql):
    """(equal, message) for a Spark frame against DuckDB SQL, as bags of rows."""
    import numpy as np

    def clean(p):
        return p.astype(object).where(p.notna(), None).map(lambda v: bool(v) if isinstance(v, np.bool_) else v)

    a_cols, a = rows(clean(df.toPandas()))
    b_cols, b = rows(clean(con.sql(sql).df()))
    if a_cols != b_cols:
        return False, f"columns {a_cols} vs {b_cols}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} vs {len(b)} rows; {str(diff)[:600]}"
    return True, f"{len(a)} rows"


def main():
    import __spark_entry__ as entry
    from wardline.session import builder

    spark = (
        builder().master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = duck(sys.argv[1]), entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or qs:
        t = time.time()
        stop = threading.Timer(60, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        stop.start()
        try:
            if name in sql:
                ok, msg = compare(qs[name](spark, sys.argv[1]), con, sql[name])
            else:
                ok, msg = True, f"{qs[name](spark, sys.argv[1]).count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        stop.cancel()
        print("ok " if ok else "BAD", name, msg, f"{time.time() - t:.1f}s", flush=True)
        bad += [] if ok else [name]
    print(len(bad), "bad:", bad)


if __name__ == "__main__":
    main()
