"""Compare a registered query with its SQL on the same tables, order-insensitively and by type."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(value).to_datetime64().astype("datetime64[us]"))
    return str(value)


def _kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "M": "time", "b": "bool"}.get(dtype.kind, "object")


def normal(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted("|".join(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def sql_frame(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).fetchdf()


def compare(name: str, spark, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs. Without SQL the rows must only be readable."""
    from voltlane.queries import ORACLES, QUERIES

    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return None if len(got) else "no rows"
    want = sql_frame(ORACLES[name], sf_dir)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} <> {sorted(want.columns)}"
    kinds = {c: (_kind(got[c].dtype), _kind(want[c].dtype)) for c in got.columns}
    bad = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if bad and len(got):
        return f"types {bad}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}; e.g. {a[:2]} / {b[:2]}"
    if not a:
        return "no rows"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} of {len(a)} rows differ, e.g. {diff[:2]} columns {sorted(got.columns)}" if diff else None


def main() -> None:
    """``python tests/oracle.py SF_DIR [names…]``; a name ending in ``*`` is a module of queries."""
    from voltlane.queries import QUERIES
    from voltlane.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in QUERIES:
        if wanted and name not in wanted and QUERIES[name].__module_name__ not in wanted:
            continue
        began = time.time()
        try:
            problem = compare(name, spark, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
