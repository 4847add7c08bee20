"""Samples to index: (fid, path, content), with file ids that are dense from 0."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlode.workers import reachable, written

#: Paths of a list that is broadcast (about 100 bytes each).
LISTED = 200_000
SCHEMA = T.StructType([T.StructField("fid", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def with_fids(df: DataFrame, *order: str) -> DataFrame:
    """Dense ids from 0 in the given order: numbers within sorted ranges plus the sizes of the ranges before.

    The sorted ranges are written once, since a second run would draw their bounds anew. Only one count per
    range goes to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    numbered = written(ranged.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    return _after(numbered, "_part", "_row").drop("_part", "_row")


def _after(rows: DataFrame, part: str, row: str) -> DataFrame:
    """`rows` with fid: the number within a part plus the sizes of the parts before it."""
    sizes = dict(sorted(rows.groupBy(part).agg(F.count("*")).collect()))
    starts, total = [], 0
    for key, n in sizes.items():
        starts.append((key, total))
        total += n
    table = rows.sparkSession.createDataFrame(starts, f"{part} {rows.schema[part].dataType.simpleString()}, _start long")
    return rows.join(F.broadcast(table), part).withColumn("fid", F.col("_start") + F.col(row)).drop("_start")


def path_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(fid, path): one path per line of a text file, numbered by line; `limit` keeps the first ones.

    The file is read in splits. A line's number is its place in its split plus the lines of the splits before.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    inside = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_at")) - 1
    numbered = _after(lines.withColumn("_row", inside), "_split", "_row")
    out = numbered.select("fid", F.rtrim("value").alias("path"))
    return out if limit is None else out.where(F.col("fid") < limit)


def _gunzip(batches):
    for batch in batches:
        content = [None if c is None else b"".join(_members(c)) for c in batch.column("content").to_pylist()]
        k = batch.schema.get_field_index("content")
        yield batch.set_column(k, batch.schema.field(k), pa.array(content, pa.binary()))


def _members(data: bytes):
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data.lstrip(b"\0")


def files(spark: SparkSession, paths: DataFrame, root: str, gzip: bool = False) -> DataFrame:
    """The listed files below `root`. `paths` is (fid, path), with paths relative to it or whole.

    A listed file that is empty or not there keeps its id and has no content (Spark's reader skips both alike).
    A list of up to LISTED paths is broadcast, and contents stay where they are read; a longer one is shuffled with them.
    """
    base = root.rstrip("/")
    bare = lambda c: F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    below = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    found = below.select(bare("path").alias("_uri"), "content")
    whole = F.when(F.col("path").startswith("/") | F.col("path").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:/"), F.col("path")).otherwise(F.concat(F.lit(f"{base}/"), F.col("path")))
    listed = paths.select("fid", "path", bare(whole).alias("_uri"))
    if listed.limit(LISTED + 1).count() > LISTED:
        out = listed.join(found, "_uri", "left")
    else:
        there = found.join(F.broadcast(listed), "_uri")
        # the listing alone: no file is opened for it
        missing = listed.join(below.select(bare("path").alias("_uri")), "_uri", "left_anti").withColumn("content", F.lit(None).cast("binary"))
        out = there.unionByName(missing)
    out = out.select("fid", "path", F.coalesce("content", F.lit(b"")).alias("content"))
    return reachable(spark) and out.mapInArrow(_gunzip, SCHEMA) if gzip else out


def from_table(df: DataFrame, key: str, content: str, path: str | None = None) -> DataFrame:
    """Samples from a table with dense ids; text is taken as UTF-8, a null as an empty sample."""
    body = F.col(content) if isinstance(df.schema[content].dataType, T.BinaryType) else F.encode(F.col(content), "UTF-8")
    name = F.col(path) if path else F.col(key).cast("string")
    return df.select(F.col(key).cast("long").alias("fid"), name.alias("path"), F.coalesce(body, F.lit(b"")).alias("content"))
