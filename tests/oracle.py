"""Runs registered queries beside their SQL on the smallest tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values) -> list:
    """Rows with their columns sorted by name, in an order of their own."""
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([v[k] for k in at]) for v in values)


def compare(spark, query, sql: str, sf_dir: str = SF) -> int:
    df = query(spark, sf_dir)
    own = [tuple(r) for r in df.collect()]
    con = connection(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    theirs = cursor.fetchall()
    assert rows(df.columns, own) == rows(names, theirs)
    return len(own)
