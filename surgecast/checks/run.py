"""Compare registered queries with their SQL twins: ``python -m surgecast.checks.run [names…]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

from .. import session
from . import load
from .compare import compare, duck


def main(names: list[str]) -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = session.build()
    reg = load()
    con = duck(sf_dir)
    bad = 0
    for name, fn in reg["QUERIES"].items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in reg["SQL"]:
                diff = compare(df, con, reg["SQL"][name])
                note = "ok" if not diff else "DIFF"
            else:
                diff, note = [], f"rows {df.count()} {df.columns}"
        except Exception as e:  # noqa: BLE001
            diff, note = [str(e)[:1500]], "ERROR"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(diff)
        print(f"{name:32s} {time.time() - t:6.2f}s {note}", flush=True)
        for d in diff:
            print("    ", d, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
