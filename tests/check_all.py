"""Run every query against its SQL at one scale and print what differs (not a test).

``python tests/check_all.py FOLDER [QUERY or KEY=VALUE ...]``; a setting such as
``spark.sql.autoBroadcastJoinThreshold=-1`` tries the plans large tables get.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from compare import connect, spark_rows, sql_rows  # noqa: E402

from shelfmark.plans.oracle import ORACLES  # noqa: E402
from shelfmark.plans.queries import registry  # noqa: E402
from shelfmark.session import build_session  # noqa: E402


def main(root: str, arguments: list[str]) -> None:
    only = [a for a in arguments if "=" not in a]
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **dict(a.split("=", 1) for a in arguments if "=" in a),
    }
    spark = build_session("check", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(root)
    bad = 0
    for name, query in registry().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, root)
            names, rows = spark_rows(df)
            took = time.time() - start
            start = time.time()
            sql_names, expected = sql_rows(connection, ORACLES[name])
            same = names == sql_names and rows == expected
            print(f"{'ok ' if same else 'BAD'} {name:28s} {len(rows):7d} {took:6.2f}s sql {time.time() - start:.2f}s")
            if not same:
                bad += 1
                print("   ", names, sql_names, len(expected))
                pairs = [(a, b) for a, b in zip(rows, expected) if a != b][:3]
                for a, b in pairs:
                    print("    spark", a, "\n    sql  ", b)
        except Exception as error:
            bad += 1
            print("ERR", name, str(error)[:700])
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
