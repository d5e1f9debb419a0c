"""Command line: python -m tests.parity [sf] [name part ...] compares queries with their SQL."""

import sys
import time

import __spark_entry__ as entry
from harborline.session import local_session
from tests.compare import differences, duck


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("parity", "8", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, run, oracles[name], sf_dir)
            else:
                found = [] if run(spark, sf_dir).count() else ["no rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '}{name} {time.time() - start:.1f}s {'' if name in oracles else '(rows)'}")
        for line in found:
            print("     ", line[:900])
    print("bad:", bad)


if __name__ == "__main__":
    main()
