"""python tools/check.py [prefix ...] — compares registered queries with DuckDB (CHECK_SF_DIR, default sf0.01)."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plateworks.plans import load  # noqa: E402
from plateworks.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main() -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = load()
    names = [q for q in queries if not sys.argv[1:] or any(q.startswith(p) for p in sys.argv[1:])]
    spark = local_session("8", "check", tempfile.mkdtemp(prefix="plateworks-check-"))
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, queries, oracles, folder)
        except Exception as exc:  # report and go on with the other queries
            ok, note = False, f"{name}: {type(exc).__name__}: {str(exc)[:350]}"
        bad += not ok
        print("ok  " if ok else "FAIL", note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
