"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int,)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.6f}"
    return str(value)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty text when both sides agree."""
    df = query(spark, sf_dir)
    names = df.columns
    ours = normal([tuple(r) for r in df.collect()], names)
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    theirs = normal(cur.fetchall(), theirs_names)
    if sorted(names) != sorted(theirs_names):
        return f"columns {sorted(names)} != {sorted(theirs_names)}"
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return (
        f"rows {len(ours)} != {len(theirs)}; only spark {sorted(a - b)[:3]}; "
        f"only duckdb {sorted(b - a)[:3]}"
    )


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from remitlens.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        began = time.time()
        try:
            if name in oracle:
                problem = differences(spark, con, sf_dir, query, oracle[name])
            else:
                problem = "" if query(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        kind = "oracle" if name in oracle else "rows"
        print(f"{'ok ' if not problem else 'BAD'} {name} [{kind}] {time.time() - began:.1f}s {problem}", flush=True)
        bad += bool(problem)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
