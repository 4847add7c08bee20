"""Growing an index from a stream: each micro-batch becomes an index part with ids after those before it.

The reference tools are batch only; this is the same algebra as a merge, applied batch by batch. A batch
that is repeated after a failure replaces its own part, and ids depend on the parts before it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.operators.index import Index, MergedIndex
from gramlode.sources.samples import with_fids


def part_folder(folder: str, batch: int) -> str:
    return f"{folder}/part-{batch:08d}"


def append_batch(folder: str):
    """A function for foreachBatch on rows (path, content)."""

    def run(batch: DataFrame, number: int) -> None:
        numbered = with_fids(batch.select("path", "content"), "path").select("fid", "path", "content")
        Index.build(numbered, part_folder(folder, number))

    return run


def open_parts(spark: SparkSession, folder: str, batches: int) -> MergedIndex:
    """All parts of the first `batches` micro-batches as one index."""
    return MergedIndex([Index.open(spark, part_folder(folder, k)) for k in range(batches)])


def samples_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as (path, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select(F.col("path"), "content")
