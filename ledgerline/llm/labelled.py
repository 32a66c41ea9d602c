"""Bounded samples of labelled documents, and the held-out rule, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerline.session import cut_lineage


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32(id as text) mod ``modulus`` = ``remainder``; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int,
                    most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most[label]`` documents a label, outside of the held-out fold. Ids are compared as
    integers where both tables hold integers, else as text.

    Documents are picked by the hash of their id. An id that is labelled more than once counts with its largest
    label, a text that occurs under an id more than once with the smallest one; rows without id, label or text are
    passed over. The ids that are broadcast are bounded by ``most``.
    """
    integers = all(isinstance(t.schema[id_col].dataType, IntegralType) for t in (docs, labels))
    key = F.col(id_col).cast("long" if integers else "string").alias("doc_id")
    known = (labels.select(key, F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").where(~in_fold("doc_id", modulus, remainder))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    picked = None
    for label, n in most.items():
        some = (known.where(F.col("label") == label)
                .orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(n))
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select(key, F.col(text_col).alias("text")).where("text IS NOT NULL")
    return cut_lineage(texts.join(F.broadcast(picked), "doc_id")
                       .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
