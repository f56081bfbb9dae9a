"""Comparison of a query with its DuckDB oracle."""


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(str([None if x is None or x != x else (round(float(x), 5) if isinstance(x, float) else x) for x in r]) for r in pdf.astype(object).values.tolist())


def assert_same(spark_df, duck, sql):
    got, want = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
