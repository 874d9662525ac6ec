"""Compare registered queries with their SQL: python tests/check.py [scale folder] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df = df.assign(**{c: df[c].astype(object).where(df[c].notna(), None)})
    by = list(df.columns)
    order = df.assign(**{c: df[c].astype(str) for c in by}).sort_values(by).index
    return df.loc[order].reset_index(drop=True)


def compare(spark, con, sf: str, name: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    import __spark_entry__ as e

    ours = e.queries()[name](spark, sf).toArrow()
    theirs = con.sql(e.oracle_sql()[name]).to_arrow_table()
    kinds = {f.name: str(f.type).replace("large_", "") for f in ours.schema}
    other = {f.name: str(f.type).replace("large_", "") for f in theirs.schema}
    if kinds != other:
        return f"schema {kinds} vs {other}"
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} vs {theirs.num_rows}"
    a, b = normal(ours.to_pandas()), normal(theirs.to_pandas())
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"column {c}, {int((~same).sum())} rows: {a.loc[at].to_dict()} vs {b.loc[at].to_dict()}"
    return None if len(a) else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as e
    from corpusflow.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                          "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in names:
        at = time.time()
        try:
            result = compare(spark, con, sf, n)
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{n}: {'ok' if result is None else result} ({time.time() - at:.1f}s)", flush=True)
