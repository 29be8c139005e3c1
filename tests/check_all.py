"""python tests/check_all.py [folder] [name ...]: compare queries with their SQL and print the differences."""

import sys
import time

import conftest  # noqa: F401
from compare import connect, differences

from rillway.session import build_session
from rillway.workload import ORACLES, QUERIES


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            if name in ORACLES:
                found = differences(spark, con, QUERIES[name], ORACLES[name], folder)
            else:
                found = [] if QUERIES[name](spark, folder).count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - begin:.1f}s", *found, sep="\n    " if found else "")
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
