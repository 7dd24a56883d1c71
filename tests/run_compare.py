"""Compare registered queries with their SQL: python tests/run_compare.py [sf] [name prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import TESTDATA, compare  # noqa: E402
from lumigrid.session import build_session  # noqa: E402

sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), tuple(sys.argv[2:])
spark = build_session("compare", cpus=8)
spark.sparkContext.setLogLevel("ERROR")
sqls = entry.oracle_sql()
failed = 0
for name, query in entry.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    start = time.time()
    try:
        if name in sqls:
            n = compare(spark, f"{TESTDATA}/sf{sf}", query, sqls[name])
        else:
            n = f"{query(spark, f'{TESTDATA}/sf{sf}').count()} (rows only)"
        print(f"ok   {name} {n} {time.time() - start:.1f}s", flush=True)
    except Exception as e:
        failed += 1
        print(f"FAIL {name} {time.time() - start:.1f}s {type(e).__name__} {str(e)[:1500]}", flush=True)
sys.exit(1 if failed else 0)
