"""Compare each query with its oracle SQL in DuckDB: python tests/oracle.py [sf_dir] [name...]."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def _plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return float(x) if type(x).__name__ == "Decimal" else x


def same(a, b) -> bool:
    return all(
        x == y or (isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)
    )


def compare(spark, sf_dir: str, name: str, run, sql: str) -> str:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    cols, got = rows_of(run(spark, sf_dir))
    if cols != sorted(names):
        return f"columns {cols} {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} expected"
    bad = [(g, w) for g, w in zip(got, want) if not same(g, w)]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from quarry.session import get_session

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark, sqls = get_session(), e.oracle_sql()
    for n, f in e.queries().items():
        if (names and n not in names) or (not names and (n.startswith("op") or n == "pipeline")):
            continue
        t = time.time()
        try:
            out = compare(spark, sf, n, f, sqls[n]) if n in sqls else f"(no SQL) {f(spark, sf).count()} rows"
        except Exception as x:
            out = f"ERROR {str(x)[:400]}"
        print(n, "ok" if not out else str(out)[:500], f"{time.time() - t:.1f}s", flush=True)
