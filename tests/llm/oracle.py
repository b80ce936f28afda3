"""A query beside its SQL on the same tables, as multisets of rows."""

from collections import Counter

import duckdb

from codeloom.llm import queries


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def both(spark, name, folder, *tables):
    """What the query gives and what its SQL gives over the folder's tables."""
    con = duckdb.connect()
    for t in tables:
        arrow = spark.read.parquet(f"{folder}/{t}.parquet").toArrow()
        con.register(t, arrow)
    asked = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(asked.columns)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(asked.columns, asked.fetchall())
