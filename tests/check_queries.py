"""Compare all (or the named) queries with their SQL: python tests/check_queries.py SF [name ...]"""

from __future__ import annotations

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tests.compare import compare, duck  # noqa: E402
from tilewright import build_session  # noqa: E402


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        try:
            problem, a, b, n, *notes = compare(spark, sf_dir, queries[name], oracle.get(name), con)
        except Exception as error:  # noqa: BLE001
            traceback.print_exc(limit=-3)
            problem, a, b, n, notes = f"{type(error).__name__}: {str(error)[:300]}", 0, 0, 0, []
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} spark {a:6.2f}s duck {b:6.2f}s rows {n} {problem or ''} {notes[0] if notes and notes[0] else ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
