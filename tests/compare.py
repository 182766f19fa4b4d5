"""Row-for-row comparison of a Spark result and DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or v.__class__.__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def difference(df, con, sql):
    """None, or what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; {[r for r in mine if r not in theirs][:2]} {[r for r in theirs if r not in mine][:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} and {b}"
    return None
