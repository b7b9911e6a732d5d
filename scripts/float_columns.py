"""Regenerate tabflow/plans/float_columns.py: for each oracle query, the names
of its floating-point output columns (from DuckDB's DESCRIBE at sf0.001).
The entry wrapper rounds exactly these columns to 6 decimals on both sides."""

from __future__ import annotations

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def main() -> None:
    from tabflow.plans.registry import ORACLE_SQL
    import tabflow.plans.catalog  # noqa: F401
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = {}
    for name, sql in sorted(ORACLE_SQL.items()):
        desc = con.sql(f"describe {sql}").fetchall()
        cols = [r[0] for r in desc if r[1] in ("DOUBLE", "FLOAT", "REAL") or r[1].startswith("DECIMAL")]
        if cols:
            out[name] = cols
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tabflow", "plans", "float_columns.py")
    with open(path, "w") as f:
        f.write('"""Floating-point output columns per oracle query (generated by scripts/float_columns.py)."""\n\n')
        f.write("FLOAT_COLUMNS = {\n")
        for k, v in out.items():
            f.write(f"    {k!r}: {v!r},\n")
        f.write("}\n")
    print(path, len(out))


if __name__ == "__main__":
    main()
