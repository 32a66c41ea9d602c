"""Hash samples at any number of rows."""
import random

from ledgerline.llm import samples as S
from pyspark.sql import functions as F


def test_samples_never_empty_by_their_number_of_rows(spark):
    """For each number of rows, up to 10^14, the part of the hashes that is taken holds what was asked for."""
    for rows in (0, 1, 100, 16_384, 10 ** 6, 10 ** 9, 10 ** 12, 10 ** 14):
        for most in (64, 8_192, 16_384):
            there = S.threshold(rows, most) / S.RANGE * rows
            assert there == rows if rows <= most else abs(there - most) < 1
    marks = [random.Random(1).getrandbits(63) - (1 << 62) for _ in range(3)] + [0, -1, (1 << 63) - 1]
    df = spark.createDataFrame([(m,) for m in marks], "m long")
    assert df.where(S.picked(F.col("m"), 5, 10)).count() == len(marks)
    assert df.where(S.picked(F.col("m"), 10 ** 12, 16_384)).collect() == [(0,)]


def test_about_as_many_as_asked_for(spark):
    df = spark.range(200_000).where(S.picked(F.xxhash64("id"), 200_000, 5_000))
    assert 4_700 < df.count() < 5_300
