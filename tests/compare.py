"""Compare a Spark result with the SQL oracle: names, types, rows, values."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SPARK_NAMES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _ordered(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    frame = frame[names].copy()
    sort_keys = pd.DataFrame(
        {
            c: frame[c].astype("float64").astype("float32") if frame[c].dtype.kind in "fiu" else frame[c].astype(str)
            for c in names
        }
    )
    return frame.loc[sort_keys.sort_values(names, kind="stable").index].reset_index(drop=True)


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    names = sorted(df.columns)
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(types) != names:
        return [f"columns differ: spark {names} oracle {sorted(types)}"]
    want = _ordered(cur.df(), names)
    got = _ordered(df.toPandas(), names)
    out = []
    for n, kind in dict(df.dtypes).items():
        if SPARK_NAMES.get(types[n], types[n].lower()) != kind:
            out.append(f"type of {n}: spark {kind} oracle {types[n]}")
    if len(got) != len(want):
        return out + [f"rows: spark {len(got)} oracle {len(want)}"]
    for n in names:
        a, b = got[n], want[n]
        if a.dtype.kind in "fiu" or b.dtype.kind in "fiu":
            same = np.isclose(a.astype("float64"), b.astype("float64"), rtol=1e-9, atol=1e-12, equal_nan=True)
        else:
            same = ((a == b) | (a.isna() & b.isna())).to_numpy()
        if not same.all():
            i = np.flatnonzero(~same)[:show]
            out.append(f"{n}: {int((~same).sum())} rows differ, e.g. {[(a[k], b[k]) for k in i]}")
    return out
