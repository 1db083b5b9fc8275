"""Session settings, shared folders and table access of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquill.llm.arrays import BATCH_ROWS

SPACES = " \t\n\x0b\f\r"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts holds, in rows and in bytes (a row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset: a temporary one in local mode, which has one machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='skyquill-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised frame whose readers are done."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = getattr(df, "_folder", None)
    if path is not None:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it waits for the driver to collect garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def unit_interval(*parts: Column) -> Column:
    """A value in [0, 1) from the md5 of the parts; the same in other SQL engines."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def fold(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(column.cast("string")) % n


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], rows: int) -> DataFrame:
    """_h, _d (hashes of id and text), _t (whole text) and labels, all 0 or 1, of the documents of the first ``rows`` labelled ids in the order of a hash.

    The ids are chosen among the labels alone, and their number is the bound; an id that is labelled twice takes part with its least labels, and rows
    that share id and text are one. Only chosen documents leave their tasks.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), *label_cols).filter(F.col("_id").isNotNull())
    for c in label_cols:
        chosen = chosen.filter(F.col(c).isin(0, 1))
    n = chosen.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    if n > 2 * rows:  # thins the rows before the exact cut below; about twice as many as needed are left
        chosen = chosen.filter(place < int((1 << 30) * 2 * rows / n))
    chosen = chosen.groupBy("_id").agg(*[F.min(F.col(c)).cast("int").alias(c) for c in label_cols]).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).join(F.broadcast(chosen), "_id")  # ``rows`` ids
    return found.select("_h", F.xxhash64("_t").alias("_d"), "_t", *label_cols).dropDuplicates(["_h", "_d"])
