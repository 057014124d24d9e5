"""Run registered queries beside their SQL: python tests/check_oracle.py <sf_dir> [name …]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from prefspark.session import build_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("prefspark-check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, statements, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = query(spark, sf_dir)
            if name in statements:
                problem, rows = difference(result, connection, statements[name]), ""
            else:
                problem, rows = None, f"rows only: {result.count()}"
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
            if len(names) == 1:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {rows} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
