"""S2-S4: JSON feeds (service/booking pages, daily analytics rows, webhook
messages) as DataFrames with one JSON document per row in ``payload``.

Landed files are read with ``spark.read.text`` (one document per line) so the
parse happens in the operators with explicit schemas — no schema inference
pass over the data. Paged responses are exploded into one row per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files -> (source_file, payload)."""
    return spark.read.text(path).select(F.input_file_name().alias("source_file"), F.col("value").alias("payload"))


def explode_page(pages: DataFrame, records_field: str, payload_col: str = "payload") -> DataFrame:
    """One paged API response per row (``{"<field>": [ {...}, ... ], ...}``) ->
    one row per record, each record kept as its JSON text, with its position."""
    recs = F.from_json(payload_col, f"struct<{records_field}: array<string>>")[records_field]
    keep = [c for c in pages.columns if c != payload_col]
    return pages.select(*keep, F.posexplode(recs).alias("pos", payload_col))


def page_total(pages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """``pagingMetadata.total`` of each page (the sync summary's total in source)."""
    return pages.select("*", F.get_json_object(payload_col, "$.pagingMetadata.total").cast("long").alias("total"))
