"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and master is local, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives a lost executor.

    The shuffle files that made it are of no more use; collecting the driver's garbage lets Spark remove them.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    del df
    gc.collect()
    spark.range(1).count()  # the JVM lets go of the last query when another has run
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.sl_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table of materialise() that nothing to come reads any more: what was made of it is written itself."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.sl_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if it has more than one in HOT_KEYS of all rows, so there are fewer hot keys than this.
HOT_KEYS, SALTS = 1000, 64


def hot_above(total: int) -> int:
    """Rows from which on a key is hot. There are fewer than HOT_KEYS such keys, so their list can be broadcast."""
    return max(total // HOT_KEYS, 1000)


def salted_join(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, hot: DataFrame, above: int, spread: str = "doc_id") -> DataFrame:
    """rows joined with counted, which has one row a key and in `n` how many of `rows` have it.

    hot: the keys with over `above` rows. Their rows are dealt to SALTS tasks by `spread`, their row of counted goes to
    each of these."""
    spots = F.when(F.col(n) > above, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_sl_hot"))), keys, "left")
    left = marked.withColumn("_sl_salt", F.when(F.col("_sl_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_sl_hot")
    return left.join(counted.withColumn("_sl_salt", F.explode(spots)).hint("merge"), [*keys, "_sl_salt"]).drop("_sl_salt")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the offsets of its n+1 boundaries."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(utf8(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def running_start(df: DataFrame, value: Column | str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one, a total order over rows without one big sort.

    Rows go to hash buckets of `order` (columns that are unique together). Buckets follow one another, rows follow
    `order` inside a bucket; only one total a bucket is gathered.
    """
    value = F.col(value) if isinstance(value, str) else value
    b = df.withColumns({"_sl_b": F.pmod(F.xxhash64(*order), F.lit(buckets)), "_sl_v": value.cast("long")})
    within = Window.partitionBy("_sl_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("_sl_b").agg(F.sum("_sl_v").alias("_sl_t"))
    before = Window.orderBy("_sl_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row a bucket: bounded by the parameter, so the single-partition window and the broadcast are too
    base = totals.select("_sl_b", F.coalesce(F.sum("_sl_t").over(before), F.lit(0)).alias("_sl_base"))
    return (
        b.withColumn("_sl_w", F.coalesce(F.sum("_sl_v").over(within), F.lit(0)))
        .join(F.broadcast(base), "_sl_b")
        .withColumn(out, F.col("_sl_base") + F.col("_sl_w"))
        .drop("_sl_b", "_sl_v", "_sl_w", "_sl_base")
    )


def replace_texts(b: pa.RecordBatch, texts: list[str | None], keep: list[bool], leave_out: str) -> pa.RecordBatch:
    """The batch with new texts (and n_chars, where there is such a column), without the rows and the column left out."""
    cols, names = [], []
    for name, col in zip(b.schema.names, b.columns):
        if name == "text":
            col = pa.array(texts, col.type)
        elif name == "n_chars" and pa.types.is_integer(col.type):
            col = pa.array([None if t is None else len(t) for t in texts], col.type)
        if name != leave_out:
            cols.append(col)
            names.append(name)
    return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))
