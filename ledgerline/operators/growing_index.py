"""V26: an index of vectors whose lists follow the rows.

A list with more rows than ``list_rows`` is split by some of its own rows (those with the smallest md5 of the id, one for
each ``list_rows`` rows and ``fanout`` at most): each row goes to the nearest by cosine, of equal ones the first. The
build starts with one list and splits in rounds, so the lists form a shallow tree, their number grows with the rows and
none is found by a driver. An append sends new rows down the tree into the lists there are and splits those that have
grown over the bound; only split lists are written anew. A search goes down with the ``beam`` nearest nodes and ranks
exactly inside the lists it ends in.

Folders: ``rows/gen=g/part=p`` (p: the top node, so that a search reads few of them) and ``nodes/gen=g``. A generation
counts once its nodes are written; a repeated append after a failure writes the same generation again. Rows whose vector
is NULL or zero are in no list. Vectors that centers can't tell apart (copies) stay in a list over the bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.session import cut_lineage

ROOT = "r"
GROUP_ROWS = 20_000          # rows of a list that one task sends on
LEVELS = 3                   # rounds of a build


def _unit(c) -> F.Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(c, lambda x: x / norm)


def unit_rows(kb: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors of length one, as doubles; without NULL and zero ones."""
    v = F.col(vec_col).cast("array<double>")
    return (kb.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0))
            .select(F.col(id_col).cast("long").alias("id"), _unit(v).alias("v")))


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _far(near: F.Column) -> F.Column:
    """A key whose ascending order is the descending one of cosines: NaN first, NULL last."""
    return F.coalesce(F.when(F.isnan(near), F.lit(float("-inf"))).otherwise(-near), F.lit(float("inf")))


def _sent_on(rows: DataFrame, kids: DataFrame) -> DataFrame:
    """Rows (id, v, cell) of cells that have kids (parent, j, center), in the nearest one's cell; others are left out."""
    sizes = (rows.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("cuts"))
             .join(F.broadcast(kids.select(F.col("parent").alias("cell")).distinct()), "cell", "left_semi"))
    packed = (kids.groupBy(F.col("parent").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("j", "center"))).alias("kids"))
              .join(F.broadcast(sizes), "cell").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))))
    own = rows.join(F.broadcast(sizes), "cell").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))

    def nearest(part: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(centers):
            return pd.DataFrame({"id": [], "v": [], "cell": []})
        c = np.array([k["center"] for k in centers["kids"].iloc[0]])
        j = np.array([k["j"] for k in centers["kids"].iloc[0]])
        best = j[np.argmax(np.vstack(part["v"].to_list()) @ c.T, axis=1)]
        return pd.DataFrame({"id": part["id"], "v": part["v"], "cell": part["cell"] + "/" + pd.Series(best.astype(str), index=part.index)})

    return (own.select("id", "v", "cell", "cut").groupBy("cell", "cut")
            .cogroup(packed.select("cell", "cut", "kids").groupBy("cell", "cut"))
            .applyInPandas(nearest, "id long, v array<double>, cell string"))


def _centers(rows: DataFrame, big: DataFrame, list_rows: int, fanout: int) -> DataFrame:
    """(parent, j, center): the rows with the smallest md5 of each list in ``big`` (cell, n)."""
    first = Window.partitionBy("cell").orderBy(F.md5(F.col("id").cast("string")), "id")
    return (rows.join(F.broadcast(big), "cell").withColumn("place", F.row_number().over(first))
            .where((F.col("place") <= fanout) & (F.col("place") <= F.ceil(F.col("n") / list_rows)))
            .select(F.col("cell").alias("parent"), (F.col("place") - 1).alias("j"), F.col("v").alias("center")))


def _split(rows: DataFrame, list_rows: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """One round over rows (id, v, cell): (rows with those of too long lists in new ones, the new nodes).

    The first round's rows are all in one list, so rows never go to one task by their list: names and sizes of long lists
    (one for each ``list_rows`` rows at most) are broadcast, and each task keeps ``fanout`` rows of a list for the nodes."""
    big = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > list_rows)
    kids = cut_lineage(_centers(rows, big, list_rows, fanout))
    stay = rows.join(F.broadcast(kids.select(F.col("parent").alias("cell")).distinct()), "cell", "left_anti")
    out = cut_lineage(stay.select("id", "v", "cell").unionByName(_sent_on(rows, kids)))
    return out, kids


def _write(rows: DataFrame, kids: DataFrame, path: str, gen: int) -> None:
    part = F.coalesce(F.nullif(F.split_part("cell", F.lit("/"), F.lit(2)), F.lit("")), F.lit("-"))
    (rows.withColumn("part", part).repartition("part", F.col("cell")).sortWithinPartitions("part", "cell")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/gen={gen}"))
    marker = kids.sparkSession.createDataFrame([(ROOT, None, None)], "parent string, j int, center array<double>")
    kids.select("parent", F.col("j").cast("int"), "center").unionByName(marker).withColumn(
        "node", F.concat("parent", F.lit("/"), F.col("j").cast("string"))).write.mode("overwrite").parquet(f"{path}/nodes/gen={gen}")


def build_index(kb: DataFrame, path: str, list_rows: int = 1_000, fanout: int = 256, levels: int = LEVELS, **cols) -> None:
    """Writes the index of ``kb`` under ``path`` (generation 0)."""
    rows = cut_lineage(unit_rows(kb, **cols).withColumn("cell", F.lit(ROOT)))
    nodes = None
    for _ in range(levels):
        rows, kids = _split(rows, list_rows, fanout)
        nodes = kids if nodes is None else nodes.unionByName(kids)
    _write(rows, nodes, path, 0)


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/nodes").parquet(f"{path}/nodes")


def lists(spark: SparkSession, path: str) -> DataFrame:
    """(id, v, cell, part, gen): the rows of the lists that are searched."""
    nodes = _nodes(spark, path)
    rows = spark.read.parquet(f"{path}/rows").join(nodes.select("gen").distinct(), "gen", "left_semi")
    split = nodes.where("node IS NOT NULL").select(F.col("parent").alias("cell")).distinct()
    return rows.join(split, "cell", "left_anti")


def append(kb: DataFrame, path: str, list_rows: int = 1_000, fanout: int = 256, **cols) -> None:
    """Adds rows as the next generation: into the lists there are, of which those over the bound are split."""
    spark = kb.sparkSession
    nodes = _nodes(spark, path)
    gen = nodes.agg(F.max("gen")).first()[0] + 1
    kids = nodes.where("node IS NOT NULL").select("parent", "j", "center")
    depth = kids.agg(F.max(F.size(F.split("parent", "/")))).first()[0] or 0
    parents = kids.select(F.col("parent").alias("cell")).distinct()
    new = unit_rows(kb, **cols).withColumn("cell", F.lit(ROOT))
    for _ in range(depth):
        new = cut_lineage(new)
        new = new.join(parents, "cell", "left_anti").select("id", "v", "cell").unionByName(_sent_on(new, kids))
    new = cut_lineage(new)
    old = lists(spark, path).select("id", "v", "cell")
    grown = (old.select("cell").unionAll(new.select("cell")).groupBy("cell").count().where(F.col("count") > list_rows)
             .join(new.select("cell").distinct(), "cell", "left_semi").select("cell"))
    touched = cut_lineage(old.join(grown, "cell", "left_semi").unionByName(new))      # their old rows too
    rows, fresh = _split(touched, list_rows, fanout)
    _write(rows, fresh, path, gen)


def _kids_met(at: DataFrame, kids: DataFrame, beam: int) -> DataFrame:
    """One row for each row of ``at``, not for each kid it meets: (query_id, u, best), best without vectors and with the
    ``beam`` nearest kids (far, cell, of) of the row's cell; a list that has no kids stays as it is."""
    near = F.transform("kids", lambda x: F.struct(_dot("u", x["center"]).alias("near"), x["node"].alias("cell")))
    near = F.transform(near, lambda x: F.struct(_far(x["near"]).alias("far"), x["cell"].alias("cell"), F.col("of")))
    best = F.when(F.col("kids").isNull(), F.array(F.struct("far", "cell", "of"))).otherwise(F.slice(F.sort_array(near), 1, beam))
    return (at.withColumn("of", F.xxhash64("u"))                  # rows of one query_id may differ in their vectors
            .join(kids, "cell", "left").select("query_id", "u", best.alias("best")))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, beam: int = 16) -> DataFrame:
    """(query_id, rank, id, similarity): the k nearest rows by cosine in the ``beam`` lists that a query ends in."""
    nodes = _nodes(spark, path).where("node IS NOT NULL").select("parent", "node", "center")
    depth = nodes.agg(F.max(F.size(F.split("parent", "/")))).first()[0] or 0
    kids = nodes.groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct("node", "center")).alias("kids"))
    at = queries.where(F.exists("query_vec", lambda x: x != 0)).select(
        "query_id", _unit(F.col("query_vec").cast("array<double>")).alias("u"), F.lit(ROOT).alias("cell"), F.lit(0.0).alias("far"))
    for level in range(depth):
        some = F.broadcast(kids.where(F.col("cell") == ROOT)) if level == 0 else kids
        met = _kids_met(at, some, beam).groupBy("query_id").agg(
            F.collect_set("u").alias("us"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, beam).alias("best"))
        at = met.select("query_id", "us", F.explode("best").alias("b")).select(
            "query_id", F.filter("us", lambda u: F.xxhash64(u) == F.col("b.of"))[0].alias("u"), "b.cell", "b.far")
    at = cut_lineage(at)
    top = F.coalesce(F.nullif(F.split_part("cell", F.lit("/"), F.lit(2)), F.lit("")), F.lit("-"))
    parts = [r[0] for r in at.select(top).distinct().collect()]                       # top nodes: fanout at most
    rows = lists(spark, path).where(F.col("part").cast("string").isin(parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return (at.join(rows, "cell").select("query_id", "id", _dot("u", "v").alias("similarity"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity")))
