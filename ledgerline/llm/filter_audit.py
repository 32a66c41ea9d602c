"""Filter interaction audit: what each of several filters removes in every order, by the potential of the removal game.

The game: a coalition S of filters removes v(S) documents, those that fail any filter of S. Its potential is
P(empty) = 0, P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, computed recursively over all coalitions. The
Shapley value of filter i is P(all) - P(all without i). What a filter removes at its step of an order is
v(before and i) - v(before), a difference of two coalitions, so no order is applied to the documents: they are read
once and counted by (part, set of failed filters), and 2^5 numbers a part give all 120 orders.

The filters of ``text_failures``: A under 200 words; B less than half of the words are distinct; C over 2 % of the code
points are A-Z; D holds one of # $ % & * |; E the text of a smaller id.

Defined results: a NULL text counts as empty; a NULL part is the empty string; rows with the same id and text are
documents of their own, none of them smaller than another; a NULL id is neither smaller nor has smaller ones, so E never
fails; an id that is labelled more than once counts as good (toxic) if any of its labels says so; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

FILTERS = "ABCDE"
SEPARATORS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8: the text fails A, B, C, D."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = F.transform(F.array(words), lambda w: (
        F.when(F.size(w) < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long"), 2).otherwise(0)))
    return (F.get(bits, F.lit(0)) + F.when(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0)
            + F.when(F.rlike(text, F.lit("[#$%&*|]")), 8).otherwise(0))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and set of failed filters (bits, A is 1, E is 16).

    A text travels as its SHA-256 and length. The first document of each text is found by a grouping with partial
    aggregates, and met again by (text, id), so that copies of one text spread over all tasks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = cut_lineage(rows.select(
        "id", "part", F.concat(F.unhex(F.sha2(F.col("text").cast("binary"), 256)),
                               F.length("text").cast("string").cast("binary")).alias("digest"),
        text_failures(F.col("text")).alias("failed")))
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = (labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).cast("int").alias("good"),
                           (F.col("toxic") == 1).cast("int").alias("toxic")).where("id IS NOT NULL")
             .groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    rows = rows.join(firsts, ["digest", "id"], "left").join(marks, "id", "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return rows.groupBy("part", (F.col("failed") + copy).alias("failed")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _without(coalition: Column, k: int) -> Column:
    return coalition.bitwiseAND(F.lit(~(1 << k)))


def potentials(worth: Column, filters: int) -> Column:
    """filters! times the potential of every coalition (by its bits), from the worth of every coalition.

    Whole numbers: potentials are sums of dividends over coalition sizes, and all sizes divide filters!."""
    scale = factorial(filters)

    def step(p, s):
        smaller = sum((F.when(s.bitwiseAND(F.lit(1 << k)) != 0, F.get(p, _without(s, k))).otherwise(F.lit(0))
                       for k in range(filters)), F.lit(0).cast("long"))
        return F.concat(p, F.array(F.call_function(
            "div", F.get(worth, s) * F.lit(scale).cast("long") + smaller, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), step)


def games(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, n, removed, good, toxic, potential): one row a part. ``removed[S]``, ``good[S]`` and ``toxic[S]`` are the
    documents that coalition S removes, ``potential`` by ``potentials``."""
    coalitions = range(1 << filters)
    worth = lambda c: F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0))
                                for s in coalitions]).cast("array<long>")
    out = counted.groupBy("part").agg(F.sum("n").alias("n"), worth("n").alias("removed"), worth("good").alias("good"),
                                      worth("toxic").alias("toxic"))
    return out.withColumn("potential", potentials(F.col("removed"), filters))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; long counts within the part.

    kept: after the step; removed: by it; redundant: fail its filter but were removed earlier; unique_fails: fail no other
    filter; good_lost and toxic_lost: removed by it and labelled so; shapley: removed by its filter, summed over all orders."""
    n = len(FILTERS)
    every = (1 << n) - 1
    games_ = games(failures(docs, labels, id_col, text_col, part_col), n)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    rows = games_.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring(
        F.col("filter_order"), k, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0),
                         lambda s, k: F.when(k > 0, s + bit(k)).otherwise(s))
    rows = rows.withColumn("before", before).withColumn("own", bit(F.col("step")))
    at = lambda c, s: F.get(F.col(c), s)
    after, own = F.col("before") + F.col("own"), F.col("own")
    step = lambda c: at(c, after) - at(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at("removed", after)).alias("kept"), step("removed").alias("removed"),
        (at("removed", own) - step("removed")).alias("redundant"),
        (at("removed", F.lit(every)) - at("removed", F.lit(every) - own)).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"),
        (at("potential", F.lit(every)) - at("potential", F.lit(every) - own)).alias("shapley"))
