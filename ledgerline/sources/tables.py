"""S1: named table reads.

Fixture tables are parquet files ``{root}/{name}.parquet``; a deployment
reads the same names over JDBC with a partitioned read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """Resolves a table name to a DataFrame. Column pruning and filter pushdown
    happen in the parquet scan, so callers just select what they need."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    __getitem__ = table


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str,
              lower_bound: int, upper_bound: int, num_partitions: int,
              properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read: ``num_partitions`` range queries on an integer key,
    so no single task pulls the whole table through one connection."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                           upperBound=upper_bound, numPartitions=num_partitions,
                           properties=properties or {})


class StreamCatalog(Catalog):
    """Same names as streams: a file source per table (schema taken from the
    batch table once; streams never infer)."""

    def __init__(self, spark: SparkSession, root: str, max_files: int | None = None):
        super().__init__(spark, root)
        self.max_files = max_files

    def table(self, name: str) -> DataFrame:
        schema = super().table(name).schema
        r = self.spark.readStream.schema(schema)
        if self.max_files:
            r = r.option("maxFilesPerTrigger", self.max_files)
        # the stream source lists a directory; the glob filter picks this table's file(s)
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(self.root)

    __getitem__ = table
