"""Comparison of result rows."""

from collections import Counter


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def same_as_sql(spark_df, connection, sql):
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected, got = bag(cursor.fetchall(), columns), bag(map(tuple, spark_df.collect()), spark_df.columns)
    assert sorted(columns) == sorted(spark_df.columns)
    assert got == expected, f"only here {list((got - expected).items())[:3]}, only in SQL {list((expected - got).items())[:3]}"
