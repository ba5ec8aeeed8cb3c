"""Run registered queries against their reference SQL and report differences.

    python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table[name].to_pylist()] for name in names]
    return sorted(zip(*columns), key=repr)


def compare(spark, con, query, statement: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.sql(statement).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} against {sorted(theirs.column_names)}"
    kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in sorted(ours.column_names)]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    if odd:
        return f"types {odd}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {str(bad[0])[:600]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from lexivane.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, query, oracles[name], sf_dir)
            else:
                problem = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:26s} {time.time() - start:6.1f}s  {problem or 'equal'}", flush=True)


if __name__ == "__main__":
    main()
