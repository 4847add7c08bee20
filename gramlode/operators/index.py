"""An index on disk: sorted postings and the samples' paths, as Parquet datasets.

A folder holds versions, and a small file that names the current one. A write makes a new version and then replaces
that file, so readers see the old version or the new one, a crash leaves the old one, and an index can be an input
of the merge that replaces it. `vacuum` deletes what is not current.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookup
from .extract import grouped_postings, ranged_postings
from .lookup import Grams

_CURRENT = "current"
_BLOCK = str(16 << 20)


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the current version; the folder itself if it has no versions."""
    fs, at = _fs(spark, f"{folder.rstrip('/')}/{_CURRENT}")
    if not fs.exists(at):
        return folder.rstrip("/")
    return f"{folder.rstrip('/')}/{spark.read.text(at.toString(), wholetext=True).first()[0].strip()}"


def switch(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the current one, by a rename over the file that names it."""
    folder = folder.rstrip("/")
    fs, beside = _fs(spark, f"{folder}/.{_CURRENT}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    _, target = _fs(spark, f"{folder}/{_CURRENT}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, target, overwrite)


def vacuum(spark: SparkSession, folder: str) -> None:
    """Delete every version but the current one. Nobody may be reading them."""
    fs, at = _fs(spark, folder)
    keep = current(spark, folder).rsplit("/", 1)[1]
    for entry in fs.listStatus(at):
        name = entry.getPath().getName()
        if name.startswith("v-") and name != keep:
            fs.delete(entry.getPath(), True)


def write_sorted(ranged: DataFrame, path: str) -> None:
    """Rows that are in ranges of (ngram, fid) already, sorted within them: row groups of few grams each."""
    ranged.sortWithinPartitions("ngram", "fid").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", _BLOCK).parquet(path)


class Index:
    """Postings (ngram, fid) and samples (fid, path) with lookups; `fid` is dense below `numsamples`."""

    def __init__(self, postings: DataFrame, paths: DataFrame, numsamples: int, version: str | None = None):
        self.postings, self.paths, self.numsamples, self.version = postings, paths, numsamples, version

    @classmethod
    def build(cls, samples: DataFrame, folder: str, omit_zero: bool = False, partitions: int | None = None) -> Index:
        spark, version = samples.sparkSession, f"v-{uuid.uuid4().hex}"
        at = f"{folder.rstrip('/')}/{version}"
        write_sorted(ranged_postings(samples, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), omit_zero), f"{at}/postings/all")
        samples.select("fid", "path").write.parquet(f"{at}/paths")
        switch(spark, folder, version)
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        at = current(spark, folder)
        found = spark.read.schema("ngram long, fid long").option("recursiveFileLookup", "true").parquet(f"{at}/postings")
        paths = spark.read.schema("fid long, path string").parquet(f"{at}/paths")
        return cls(found, paths, paths.count(), at)

    def match_posting_lists(self, ngrams: Grams, minmatches: int) -> DataFrame:
        return lookup.at_least(self.postings, ngrams, minmatches)

    def get_posting_list(self, ngrams: Grams, groupwidth: int | None = None, tau: int | None = None) -> DataFrame | None:
        if groupwidth is None:
            return lookup.all_of(self.postings, ngrams)
        return lookup.grouped_all_of(self.postings, ngrams, self.numsamples, groupwidth, tau)

    def get_posting_list_n3(self, ngrams: Grams) -> DataFrame | None:
        return lookup.all_of_trigrams(self.postings, ngrams)

    def get_posting_list_size(self, ngrams: Grams | None = None) -> DataFrame:
        return lookup.sizes(self.postings, ngrams)

    def grouped(self, width: int) -> DataFrame:
        return grouped_postings(self.postings, width)

    def fid2path(self, fids: DataFrame) -> DataFrame:
        """(fid, path) of the given ids; ids that no sample has are left out."""
        return fids.select("fid").join(self.paths, "fid")

    def shifted(self, offset: int) -> DataFrame:
        return self.postings.withColumn("fid", F.col("fid") + offset)


def merged_postings(indexes: list[Index]) -> DataFrame:
    """Postings of several indexes, each shifted by the samples of those before it: a view, nothing is written."""
    out, offset = None, 0
    for index in indexes:
        part = index.shifted(offset)
        out = part if out is None else out.unionByName(part)
        offset += index.numsamples
    return out


class MergedIndex(Index):
    """Several indexes as one; every lookup works on it. `merge` writes it as an index of its own."""

    def __init__(self, indexes: list[Index]):
        self.indexes, offset, paths = indexes, 0, None
        for index in indexes:
            part = index.paths.withColumn("fid", F.col("fid") + offset)
            paths = part if paths is None else paths.unionByName(part)
            offset += index.numsamples
        super().__init__(merged_postings(indexes), paths, offset)

    def write(self, folder: str, partitions: int | None = None, pieces: int = 1) -> Index:
        """Write the union as an index of its own, in `pieces` ranges of grams, one after the other.

        The target may be the folder of an input. After a crash the same call goes on behind the last whole piece.
        """
        spark, folder = self.postings.sparkSession, folder.rstrip("/")
        known = [i.version for i in self.indexes]
        named = hashlib.md5("\n".join([str(pieces), *known]).encode()).hexdigest() if all(known) else uuid.uuid4().hex
        at = f"{folder}/v-{named}"
        if current(spark, folder) == at:  # this very merge is done
            return Index.open(spark, folder)
        for k in range(pieces):
            part = f"{at}/postings/piece-{k:05d}"
            fs, done = _fs(spark, f"{part}/_SUCCESS")
            if not fs.exists(done):
                rows = self.postings if pieces == 1 else self.postings.where(F.col("ngram").between((k << 32) // pieces, ((k + 1 << 32) // pieces) - 1))
                write_sorted(rows.repartitionByRange(partitions, "ngram", "fid") if partitions else rows.repartitionByRange("ngram", "fid"), part)
        self.paths.write.mode("overwrite").parquet(f"{at}/paths")
        switch(spark, folder, f"v-{named}")
        return Index.open(spark, folder)


def merge(indexes: list[Index], folder: str, partitions: int | None = None, pieces: int = 1) -> Index:
    return MergedIndex(indexes).write(folder, partitions, pieces)
