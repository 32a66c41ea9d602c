"""Small helpers of the operator tests."""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, key=0):
    """Rows ordered by their first column (NULL first)."""
    return sorted(df.collect(), key=lambda r: (r[key] is not None, r[key]))
