"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``. A session without it gets a local folder if all of it runs in this process (tests); on a cluster
    that would lose what other machines wrote, so it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spoken-checkpoint-"))


BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Lowers what Spark hands to Python at once to about ``BATCH_BYTES``: its own limit, 10,000 rows of any length, is no bound on
    texts. Limits that are lower already stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None) or "0"
        size = int(now) if now.lstrip("-").isdigit() else most + 1
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, lineage ends in files that every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame) -> DataFrame:
    """The same rows in at most two partitions for each core, or an eighth of the shuffle partitions where that is more. For narrow
    results of many rounds: a file costs the same however few rows it has. On a local folder that is two or three processes, which
    Hadoop without its native library starts to set modes, and each of them begins in the memory of the executor that starts it."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8))


def held_out(doc_id):
    """True where crc32 of the id as text leaves 2 modulo 4: rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(row_, doc_id, text): every column of ``docs`` in a struct, so that columns an operator adds cannot clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def plain(df: DataFrame) -> DataFrame:
    """The columns that went into ``keyed``."""
    return df.select("row_.*")


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet files under the checkpoint folder, read again: lineage ends, and readers take only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(spark)
    return spark.read.parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop plans, shuffles and broadcasts that nothing refers to any more. It does so when the driver's collector finds them,
    which in a program of many jobs is when the heap is full."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
