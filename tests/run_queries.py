"""Run registered queries against their SQL: ``python tests/run_queries.py [sf] [name part ...]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from compare import compare, connect  # noqa: E402

import queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main(sf="0.01", *parts):
    queries.load_all()
    spark = local_session("queries", "8")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in queries.ORACLES:
                found = compare(df, con, queries.ORACLES[name])
                note = "ok" if not found else "DIFF " + "; ".join(found)
            else:
                note = f"rows {df.count()}"
        except Exception as exc:
            note = "FAIL " + str(exc)[:1200]
        bad += not (note == "ok" or note.startswith("rows"))
        print(f"{time.time() - start:6.1f}s {name}: {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
