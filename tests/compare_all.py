"""Compare registered queries with their SQL: compare_all.py SF_DIR [name part ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from packetloom.session import local_session  # noqa: E402
from tests.oracle import compare  # noqa: E402

if __name__ == "__main__":
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = local_session()
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                note = compare(spark, name, fn, sql[name], sf_dir) or "ok"
            else:
                note = f"ok ({fn(spark, sf_dir).count()} rows, no SQL)"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += not note.startswith("ok")
        print(f"{time.time() - start:6.2f}s {name}: {note[:900]}", flush=True)
    print("differences:", bad)
