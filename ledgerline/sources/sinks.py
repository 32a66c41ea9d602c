"""S5-S7: sinks and result formats.

Keyed writes return new state, which goes into a folder of its own; then a small
file in ``_log`` publishes it: version N names the folders that hold the state.
Readers take the newest version that is whole, so a failed job changes nothing
and blocks nothing: folders and files that were never published are ignored.
The file of a version is created only if there is none, so of two writers one
gets an error. Appends are plain ``mode("append")``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampNTZType, TimestampType

from ledgerline.operators.writes import keyed_merge


class ConcurrentWrite(RuntimeError):
    """Another writer has published the version meanwhile."""


def _log(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/_log")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, base: str) -> dict[int, dict]:
    """Whole versions by number (a file that a crash left unfinished is none)."""
    fs, path = _log(spark, base)
    if not fs.exists(path):
        return {}
    out = {}
    for r in spark.read.text(path.toString(), wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value").collect():
        try:
            out[int(r["f"].split(".")[0])] = json.loads(r["value"])
        except ValueError:
            continue
    return out


def _publish(spark: SparkSession, base: str, number: int, version: dict) -> int:
    fs, path = _log(spark, base)
    jvm = spark.sparkContext._jvm
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}.json"), False)
    except Exception as e:
        raise ConcurrentWrite(f"version {number} of {base} exists") from e
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    return number


def _next_number(spark: SparkSession, base: str) -> int:
    fs, path = _log(spark, base)
    if not fs.exists(path):
        return 1
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return 1 + max([int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit()], default=0)


def current_version(spark: SparkSession, base: str) -> int | None:
    return max(_versions(spark, base), default=None)


def read_version(spark: SparkSession, base: str, number: int) -> DataFrame:
    parts = _versions(spark, base)[number]["parts"]
    return spark.read.parquet(*[f"{base.rstrip('/')}/{p}" for p in sorted(parts.values())])


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    v = current_version(spark, base)
    return None if v is None else read_version(spark, base, v)


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None) -> int:
    """Write the new state into a folder of its own, then publish it as the next version."""
    spark = df.sparkSession
    number, folder = _next_number(spark, base), f"data-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base.rstrip('/')}/{folder}")
    return _publish(spark, base, number, {"parts": {"": folder}})


def upsert_version(batch: DataFrame, base: str, key: str, order: list[str], insert_cols: list[str],
                   update_cols: list[str], epoch: int | None = None, buckets: int = 64) -> int | None:
    """Merge a batch into the current version, which is kept in buckets by key hash (rows without a key: by their
    order columns): only the buckets that the batch touches are read and written anew. An ``epoch`` that the current
    version already has is skipped (a repeated micro-batch). Returns the version, or None if skipped."""
    spark = batch.sparkSession
    base = base.rstrip("/")
    versions = _versions(spark, base)
    now = versions[max(versions)] if versions else {"parts": {}, "epoch": None}
    if epoch is not None and now.get("epoch") is not None and epoch <= now["epoch"]:
        return None
    number = _next_number(spark, base)
    bucket = F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*order)), F.lit(buckets))
    batch = batch.select(*dict.fromkeys([key, *insert_cols, *update_cols, *order])).withColumn("_bucket", bucket)
    touched = [str(r["_bucket"]) for r in batch.select("_bucket").distinct().collect()]        # at most ``buckets``
    old = [f"{base}/{now['parts'][b]}" for b in touched if b in now["parts"]]
    target = spark.read.parquet(*old) if old else None
    state = keyed_merge(target, batch, key, order, insert_cols, update_cols)
    own = F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(
        F.xxhash64(*[c if c in state.columns else F.lit(None) for c in order])), F.lit(buckets))
    folder = f"data-{uuid.uuid4().hex}"
    state.withColumn("_bucket", own).write.mode("error").partitionBy("_bucket").parquet(f"{base}/{folder}")
    parts = {**now["parts"], **{b: f"{folder}/_bucket={b}" for b in touched}}
    return _publish(spark, base, number, {"parts": parts, "epoch": epoch})


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def api_format(df: DataFrame) -> DataFrame:
    """Result format of the source API: ISO timestamps, ``YYYY-MM-DD`` dates,
    decimals as floats — column by column, still a DataFrame."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (``to_json``), e.g. for a message queue sink."""
    f = api_format(df)
    return f.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in f.columns])).alias("value"))


def clear_table(spark: SparkSession, base: str, name: str, allowed: tuple[str, ...]) -> int:
    """Truncate an allow-listed table: write an empty version with the same schema
    (older versions stay readable until cleaned up)."""
    if name not in allowed:
        raise ValueError(f"Invalid table name. Must be one of: {list(allowed)}")
    cur = read_current(spark, base)
    if cur is None:
        raise ValueError(f"no table at {base}")
    return write_version(cur.limit(0), base)
