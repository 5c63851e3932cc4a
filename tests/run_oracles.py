"""Developer tool: python tests/run_oracles.py [sf_dir] [name ...]"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from rankflow.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session("local[8]", 8)
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
bad = 0
for name in names or list(qs):
    t = time.time()
    try:
        df = qs[name](spark, sf)
        if name in sqls:
            info = compare(df, con, sqls[name])
        else:
            info = {"ok": None, "spark_rows": df.count(), "oracle": "none"}
    except Exception as e:  # noqa: BLE001
        info = {"ok": False, "error": repr(e)[:600]}
    info["sec"] = round(time.time() - t, 2)
    bad += info.get("ok") is False
    print(name, json.dumps(info, default=str), flush=True)
print("FAILED", bad)
