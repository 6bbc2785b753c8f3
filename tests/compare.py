"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime


def _cell(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(names)
    return order, Counter(tuple(_cell(r[names.index(n)]) for n in order) for r in result.fetchall())


def assert_same(df, con, sql):
    spark_names, spark_rows = rows_of_spark(df)
    duck_names, duck_rows = rows_of_duck(con, sql)
    assert spark_names == duck_names
    assert spark_rows == duck_rows, (
        f"only Spark: {list((spark_rows - duck_rows).items())[:3]}; only SQL: {list((duck_rows - spark_rows).items())[:3]}"
    )
