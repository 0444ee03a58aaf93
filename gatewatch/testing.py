"""Result comparison used by the tests and ``check_oracle.py``.

Mirrors the driver's check: row count, column names (sorted) and an
order-insensitive comparison of values, doubles rounded to 6 digits.
"""

from __future__ import annotations

import datetime as _dt
import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (_dt.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v).tz_localize(None) if getattr(v, "tzinfo", None) else pd.Timestamp(v))
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    rows.sort(key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))
    return cols, rows


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame, tol: float = 1e-6) -> list[str]:
    problems = []
    sc, sr = rows_of(spark_pdf)
    oc, orr = rows_of(oracle_pdf)
    if sc != oc:
        problems.append(f"columns differ: spark={sc} oracle={oc}")
        return problems
    if len(sr) != len(orr):
        problems.append(f"row count differs: spark={len(sr)} oracle={len(orr)}")
    bad = 0
    for a, b in zip(sr, orr):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                if abs(x - y) > tol * max(1.0, abs(y)):
                    bad += 1
                    if bad <= 3:
                        problems.append(f"value differs: spark={a} oracle={b}")
                    break
            elif x != y:
                bad += 1
                if bad <= 3:
                    problems.append(f"value differs: spark={a} oracle={b}")
                break
    if bad:
        problems.append(f"{bad} differing rows")
    return problems


_SPARK_FAMILY = {"bigint": "int", "int": "int32", "smallint": "int", "tinyint": "int", "double": "float",
                 "float": "float", "string": "str", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts",
                 "date": "date"}
_DUCK_FAMILY = {"BIGINT": "int", "INTEGER": "int32", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float",
                "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date"}


def type_mismatches(spark_dtypes: list[tuple[str, str]], duck_rel) -> list[str]:
    """Column type families that differ between a Spark result and DuckDB."""
    d = {c: str(t).split("(")[0] for c, t in zip(duck_rel.columns, duck_rel.types)}
    out = []
    for c, t in spark_dtypes:
        a, b = _SPARK_FAMILY.get(t, t), _DUCK_FAMILY.get(d.get(c, "MISSING"), d.get(c, "MISSING"))
        if a != b:
            out.append(f"{c}: spark={t} duck={d.get(c)}")
    return out
