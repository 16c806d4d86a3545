"""Run every catalog query against its oracle: python -m tests.run_oracle [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time

from loadkit.catalog import ORACLE, QUERIES
from loadkit.session import build_session
from tests.oracle import compare, duck


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = build_session("oracle-check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                problems, n = compare(df, con, ORACLE[name])
            else:
                problems, n = [], df.count()
            status = "OK " if not problems else "BAD"
            bad += bool(problems)
            tag = "" if name in ORACLE else " (rows only)"
            print(f"{status} {name:28s} rows={n:<8d} {time.time() - t0:6.2f}s{tag}", flush=True)
            for p in problems:
                print("     ", p[:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {name:28s} {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
