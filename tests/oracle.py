"""Compare queries with their SQL: names, kinds and values, in any order."""

import datetime
import math

import duckdb
from pyspark.sql.types import IntegralType

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=str)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, sql, sf_dir):
    """What differs, or an empty string."""
    got_names, got = df.columns, df.collect()
    cur = connect(sf_dir).execute(sql)
    names, kinds, want = [c[0] for c in cur.description], [str(c[1]) for c in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(names):
        return f"names {sorted(got_names)} {sorted(names)}"
    for f in df.schema.fields:
        kind = kinds[names.index(f.name)]
        if isinstance(f.dataType, IntegralType) != ("INT" in kind) or (f.dataType.typeName() == "integer") != (kind == "INTEGER"):
            return f"kind of {f.name}: {f.dataType.typeName()} {kind}"
    a, b = rows_of(got_names, got), rows_of(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {sorted(names)}; {diff or (a[-1:], b[-1:])}"
    return ""
