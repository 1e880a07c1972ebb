"""Side-by-side comparison of a query with its SQL, as rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return value + 0.0
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_df, con, sql: str) -> str:
    """Empty where both have the same columns and rows."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs, kinds = got.fetchall(), [str(c[1]) for c in got.description]
    ours = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    a, b = rows(spark_df.columns, ours), rows(names, theirs)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{len(a)} and {len(b)} rows; {diff}; {kinds}"
    return ""
