"""Runs a registered query and its SQL twin on the same tables and compares them."""

import decimal
import math

import duckdb

from signalweir.registry.views import TABLES


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    dtypes = [str(d[1]) for d in rel.description]
    drows = rel.fetchall()
    srows = [tuple(r) for r in df.collect()]
    c1, r1 = rows_of(df.columns, srows)
    c2, r2 = rows_of(dcols, drows)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}; spark {r1[:2]} duck {r2[:2]}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)}/{len(r1)} rows differ; spark {bad[0][0]} duck {bad[0][1]}"
    kinds = dict(zip(dcols, dtypes))
    wide = [c for c, t in kinds.items() if "HUGEINT" in t or "DECIMAL" in t]
    if wide:
        return f"oracle columns of wide type {wide}"
    return None
