"""Run registered queries one by one and report time, rows and differences: check.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from tablewright.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else oracle.SF_DIR
    wanted = sys.argv[2:]
    spark = build_session("check", 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sql = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problems = oracle.compare(df, sql[name], sf_dir)
                note = "ok" if not problems else "; ".join(problems)
            else:
                note = f"rows only: {df.count()}"
                problems = []
        except Exception as error:  # noqa: BLE001
            problems = [str(error)]
            note = "ERROR " + str(error)[:700]
            if wanted:
                traceback.print_exc()
        bad += bool(problems)
        print(f"{name:28s} {time.time() - start:6.2f}s {note[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
