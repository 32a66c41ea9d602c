"""T49 with intersections: bitmaps of ids for each facet value, so that any combination is counted without a new scan.

The index has one row for each facet value and block of 32,768 ids that holds one of them: (facet, value, bucket, bits).
It is built in one scan and one shuffle, rows of new ids are merged by OR, and the documents that have all values of a
combination are counted by AND of a combination's bitmaps in each block: at most as many rows meet in a group as the
combination has values, however frequent a value is.

Defined results: an id counts once for a value, however often it is repeated; rows without an id are in no bitmap; a
NULL value is no value; a combination whose values never meet (or don't exist) counts 0; an empty one is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBO = "array<struct<facet:string,value:string>>"


def value(facet: str, of) -> Column:
    return F.struct(F.lit(facet).alias("facet"), (F.col(of) if isinstance(of, str) else of).alias("value"))


def facet_bitmaps(techniques: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(facet, value, bucket, bits) for categories, risk levels and materials; ids are integers from 0."""
    values = F.concat(F.array(value("category", "category"), value("risk_level", "risk_level")),
                      F.transform(F.coalesce("materials", F.array().cast("array<string>")), lambda m: value("material", m)))
    pairs = (techniques.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(values).alias("f"))
             .where("f.value IS NOT NULL"))
    return (pairs.groupBy("f.facet", "f.value", F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")))


def merge_bitmaps(index: DataFrame, newer: DataFrame) -> DataFrame:
    """The index of both parts, which may share ids."""
    return index.unionByName(newer).groupBy("facet", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def top_values(index: DataFrame, facet: str, n: int) -> DataFrame:
    """(value) of the ``n`` values with the most ids, ties to the smaller value."""
    return (index.where(F.col("facet") == facet).groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("ids"))
            .orderBy(F.desc("ids"), "value").limit(n).select("value"))


def count_combinations(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(combo, n): ids that have all values of ``combo`` (array of facet, value), for each distinct one of ``wanted``."""
    parts = (wanted.select(F.array_sort(F.array_distinct(F.col("combo").cast(COMBO))).alias("combo")).distinct()
             .select("combo", F.explode("combo").alias("f")).select("combo", "f.facet", "f.value"))
    met = (parts.join(index, ["facet", "value"], "left").groupBy("combo", "bucket")
           .agg(F.bitmap_and_agg("bits").alias("bits"), F.count("bits").alias("parts")))
    n = F.when(F.col("parts") == F.size("combo"), F.bitmap_count("bits")).otherwise(F.lit(0))
    return met.groupBy("combo").agg(F.sum(n).alias("n"))


def material_combinations(materials: DataFrame, categories, risks) -> DataFrame:
    """(combo): each of ``materials`` (value) with every category, every risk level and every pair of both."""
    m = value("material", "value")
    cats = [value("category", F.lit(c)) for c in categories]
    levels = [value("risk_level", F.lit(r)) for r in risks]
    combos = [F.array(*rest, m) for rest in [(c,) for c in cats] + [(r,) for r in levels] + [(c, r) for c in cats for r in levels]]
    return materials.select(F.explode(F.array(*combos)).alias("combo"))


def facet_combinations(techniques: DataFrame, categories, risks, materials: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(category, risk_level, material, n) of the combinations that occur of the ``materials`` most frequent materials
    with categories, risk levels and both; NULL stands for any."""
    index = facet_bitmaps(techniques, id_col)
    counted = count_combinations(index, material_combinations(top_values(index, "material", materials), categories, risks))
    of = F.map_from_entries("combo")
    return counted.where("n > 0").select(of["category"].alias("category"), of["risk_level"].alias("risk_level"),
                                         of["material"].alias("material"), "n")
