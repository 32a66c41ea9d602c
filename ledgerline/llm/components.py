"""Connected components of a link table by alternating large-star and small-star steps.

Each step points nodes at the smallest neighbour they know of; a few rounds (logarithmic in the longest path) turn
every component into a star. All work is joins and aggregations by node. A node with very many links is no single
task: minima are pre-aggregated, and joins run on (node, salt) with an exchange on either side, so that adaptive
execution can split what is still large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

SALTS = 4


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins a table with any number of rows for a key to one with a row for a key (which is repeated by salt)."""
    rest = [c for c in many.columns if c != key]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rest]), F.lit(salts)) if rest else F.lit(0).cast("long")
    a = many.withColumn("__salt", salt)
    b = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node point at the smallest of it and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (salted_join(both.where("v > u"), least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (salted_join(down, least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def _sign(links: DataFrame):
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node of the component, for
    which there is a row too. Links from a node to itself add nothing."""
    now = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    sign = _sign(now)
    for _ in range(max_rounds):
        if not sign[0]:
            break
        new = cut_lineage(_small_star(_large_star(now)))
        old, sign, now = sign, _sign(new), new
        if sign == old:
            break
    else:
        raise RuntimeError("components don't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
