"""Spark queries beside their SQL on DuckDB. Usage: python tests/parity.py FOLDER [NAME...]"""

import math
import sys
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime) and not (v.hour or v.minute or v.second or v.microsecond):
        return v.date().isoformat()
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return v


def compare(spark, query, sql, folder):
    """None if both give the same rows, else what differs."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    con.execute("SET TimeZone = 'UTC'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    df = query(spark, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    theirs = sorted((tuple(cell(r[i]) for i in at) for r in want.fetchall()), key=repr)
    ours = sorted((tuple(cell(v) for v in r) for r in df.select(*order).collect()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ in {order}, first: {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from spanledger.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) == 2 or name in sys.argv[2:]:
            try:
                said = compare(spark, entry.queries()[name], sql, sys.argv[1]) or "equal"
            except Exception as e:  # show all of them
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(name, said, flush=True)
