"""Run registered queries against their SQL: check_queries.py [folder] [query or module name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, differences  # noqa: E402

from reefline.catalogue import REGISTRY  # noqa: E402
from reefline.session import local_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    names = [
        n
        for n, q in REGISTRY.items()
        if not wanted or n in wanted or q.run.__module__.rsplit(".", 1)[-1] in wanted
    ]
    spark, con, bad = local_session(8), connect(folder), 0
    for name in names:
        q = REGISTRY[name]
        start = time.time()
        try:
            df = q.run(spark, folder)
            sizes: list[int] = []
            found = differences(df, con, q.sql, sizes) if q.sql else []
            note = f"rows {sizes}" if q.sql else f"rows {df.count()} (no SQL)"
        except Exception as error:  # noqa: BLE001
            found, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {note}", *found, sep="\n     " if found else " ", flush=True)
    print("failed:", bad, "of", len(names))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
