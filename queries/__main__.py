"""python -m queries [name ...]: compare catalogue queries with their SQL at $SF_DIR."""

import os
import sys
import time

from stormline.session import local_session

from . import load
from .compare import compare, connect


def main() -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    known, texts = load()
    spark = local_session("queries", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:]
    names = [n for n in known if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in texts:
                verdict = compare(spark, con, known[name], texts[name], sf_dir)
            else:
                verdict = f"ROWS {len(known[name](spark, sf_dir).collect())}"
        except Exception as error:  # noqa: BLE001 - the harness reports and goes on
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += bool(verdict) and not verdict.startswith("ROWS")
        print(f"{'ok  ' if not verdict else 'FAIL' if not verdict.startswith('ROWS') else 'rows'} {name} {time.time() - began:.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 99))
