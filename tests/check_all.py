"""Compare every registered query with its oracle: python tests/check_all.py [dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_point
from poolsight.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(root)
    oracles = entry_point.oracle_sql()
    bad = 0
    for name, fn in entry_point.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, root)
            if name in oracles:
                problem = compare(con, df, oracles[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
                name = f"{name} (rows only, {n})"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
