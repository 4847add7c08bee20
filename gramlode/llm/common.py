"""Shared session, table and skew helpers of the subpackage."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.workers import reachable, shared_folder

#: Bytes of one Arrow batch sent to a Python worker: long texts make short batches.
BATCH_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, whatever the length of the texts, and let shuffle files go with their query."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return reachable(spark)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its own rules hold
        return None


def tidy(run):
    """A mapInArrow function whose worker gives its memory back when a task ends; workers outlive their tasks."""

    def wrapped(batches):
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: large arrays go back as soon as they are freed
        try:
            yield from run(batches)
        finally:
            if libc is not None:
                libc.malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and that nothing later reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(x) with x bound to `value`, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key is hot with at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE such keys.
HOT_SHARE = 500


def lookup(rows: DataFrame, unique: DataFrame, key: str, counts: str) -> DataFrame:
    """Left join of `rows` to one row per key, safe for keys with a large share of the rows.

    `unique` has the column `counts` with the rows of each key. The at most HOT_SHARE keys that have
    1/HOT_SHARE of all rows or more are broadcast, the others are joined by a shuffle, in which
    none of them can fill a partition.
    """
    total = unique.agg(F.coalesce(F.sum(counts), F.lit(0)).alias("_total"))
    marked = unique.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(counts) * HOT_SHARE >= F.greatest(F.col("_total"), F.lit(HOT_SHARE * 100)))
    hot = marked.where("_hot").drop("_total", counts)
    cold = marked.where("not _hot").drop("_total", "_hot", counts)
    names = [c for c in unique.columns if c not in (key, counts)]
    first = rows.join(F.broadcast(hot), key, "left")
    warm = first.where("_hot").drop("_hot")
    cool = first.where("_hot is null").drop("_hot", *names).join(cold, key, "left")
    return warm.unionByName(cool)


def spread(rows: DataFrame, unique: DataFrame, key: str, by: str, how: str = "inner", counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Join of `rows` to one row per key, safe for keys with a large share of the rows and for wide rows of `unique`.

    A key with 1/HOT_SHARE of the rows or more is salted by the column `by`, in parts of about that share, and its row
    of `unique` goes to each part. `counted` says how often keys occur, for rows that are costly to run twice, and `counts`
    (key, _n) where that is known: the rows are not shuffled to count them then. Only the at most HOT_SHARE such keys and
    their numbers of parts are broadcast.
    """
    if counts is None:
        counts = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.greatest(F.coalesce(F.sum("_n"), F.lit(0)), F.lit(HOT_SHARE * 100)).alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * HOT_SHARE >= F.col("_total")).select(key, F.ceil(F.col("_n") * HOT_SHARE / F.col("_total")).alias("_parts"))
    found = hot.collect()  # at most HOT_SHARE rows
    if not found:
        return rows.join(unique, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    right = unique.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
