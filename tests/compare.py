"""Holds queries against their SQL, as the driver does: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(df):
    import pandas as pd

    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "" if v is None or (not isinstance(v, (list, tuple, dict)) and not hasattr(v, "__len__") and pd.isna(v)) else (f"{v:.6f}" if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and not isinstance(v, str) and getattr(v, "ndim", 0) else str(int(v)) if isinstance(v, bool) else str(v)))
    return df.sort_values(list(df.columns), ignore_index=True)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from sightline.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, sql = duck(sf_dir), 0, e.oracle_sql()
    for name, f in e.queries().items():
        if names and not any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            a = f(spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in sql:
                print(f"{name}: {len(a)} rows, {took:.1f} s, no SQL", flush=True)
                continue
            b = con.execute(sql[name]).df()
            x, y = norm(a), norm(b)
            ok = list(x.columns) == list(y.columns) and x.equals(y)
            print(f"{name}: {len(a)} rows, SQL {len(b)}, {took:.1f} s, {'same' if ok else 'DIFFERENT'}", flush=True)
            if not ok:
                bad += 1
                print("  columns", list(x.columns), list(y.columns))
                if list(x.columns) == list(y.columns):
                    m = x.merge(y, how="outer", indicator=True)
                    print(m[m["_merge"] != "both"].head(8).to_string(max_colwidth=60))
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(ex).__name__} {str(ex)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
