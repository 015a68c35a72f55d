"""Incremental scans as a stream: new files arrive in a folder, each micro-batch is scanned and merged."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.text import normal_path
from siltstone.operators.core import latest_wins
from siltstone.operators.history import changed_files, upsert_cache
from siltstone.schemas import FILES, SCAN_CACHE

#: Parts of the cache by a hash of the path; a batch reads only those that it touches.
BUCKETS = 64
#: So many files of one level of a part are merged to one of the next level.
FAN = 8


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of (path, language, content, line_count, ord) as they arrive."""
    return spark.readStream.schema(FILES).parquet(folder)


def _bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    """(part, version, level) of what the cache holds: FAN files a level of a part, and levels grow with the logarithm of the batches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(f"{folder}/b=*/v=*/l=*")) if fs.exists(root) else []
    numbers = [[int(piece.split("=")[1]) for piece in f.getPath().toString().rstrip("/").split("/")[-3:]] for f in found]
    return sorted((b, v, level) for b, v, level in numbers)


def _read(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with ``epoch``, the batch that wrote them."""
    kind = f"{SCAN_CACHE}, epoch long"
    paths = [f"{folder}/b={b}/v={v}/l={level}" for b, v, level in files]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def _merge_levels(spark: SparkSession, folder: str, epoch: int, touched: list[int]) -> None:
    """Merges the files of levels that are full, of batches before this one alone: what a repeated batch reads stays.

    A row is rewritten once a level, so that a batch's share of all rewriting grows with the logarithm of the number of batches.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while True:
        held = [f for f in _files(spark, folder) if f[0] in touched and f[1] < epoch]
        full = {(b, level) for b, _, level in held if sum(x[0] == b and x[2] == level for x in held) >= FAN}
        if not full:
            return
        old = [f for f in held if (f[0], f[2]) in full]
        rows = latest_wins(_read(spark, folder, old).withColumn("b", _bucket(F.col("path"))), ["repo_path", "path"], "epoch")
        newest = {(b, level): max(v for x, v, y in old if (x, y) == (b, level)) for b, level in full}
        to = F.from_json(F.lit(json.dumps({str(b): {"v": newest[b, level], "l": level + 1} for b, level in sorted(full, reverse=True)})), "map<string,struct<v:int,l:int>>")[F.col("b").cast("string")]
        rows.withColumn("v", to["v"]).withColumn("l", to["l"]).repartition(len({b for b, _ in full}), "b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v", "l").parquet(folder)
        for b, v, level in old:
            fs.delete(hadoop.Path(f"{folder}/b={b}/v={v}/l={level}"), True)


def touched_parts(batch: DataFrame) -> list[int]:
    """Parts of the cache that a batch's paths fall into (BUCKETS at most)."""
    return sorted(r["b"] for r in batch.select(_bucket(normal_path(F.col("path"), mount=True)).alias("b")).distinct().collect())


def merge_cache(spark: SparkSession, folder: str, batch: DataFrame, epoch: int, repo_path: str, now) -> None:
    """Adds a batch's rows as a file of each part that it touches; a batch that runs twice writes the same ones.

    Nothing that is there is rewritten but by the merging of full levels.
    """
    touched = touched_parts(batch)
    if not touched:
        return
    _merge_levels(spark, folder, epoch, touched)
    new = upsert_cache(spark.createDataFrame([], SCAN_CACHE), batch, repo_path, now)
    out = new.withColumn("epoch", F.lit(epoch).cast("long")).withColumn("b", _bucket(F.col("path"))).withColumn("v", F.lit(epoch)).withColumn("l", F.lit(0))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v", "l").parquet(folder)


def read_cache(spark: SparkSession, folder: str, epoch: int, parts: list[int] | None = None) -> DataFrame:
    """The cache as of an epoch, or some of its parts: the latest row of each path; empty before the first."""
    files = [f for f in _files(spark, folder) if f[1] <= epoch and (parts is None or f[0] in parts)]
    return latest_wins(_read(spark, folder, files), ["repo_path", "path"], "epoch").drop("epoch")


def scan_stream(files: DataFrame, detect: Callable[[DataFrame], DataFrame], cache_folder: str, out_folder: str, checkpoint: str, repo_path: str, now) -> StreamingQuery:
    """Per micro-batch: keep files whose content changed, detect, write the rows of that batch, merge the cache."""
    spark = files.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        changed = changed_files(batch, read_cache(spark, cache_folder, epoch - 1, touched_parts(batch)), repo_path)
        detect(changed).write.mode("overwrite").parquet(f"{out_folder}/batch={epoch}")
        merge_cache(spark, cache_folder, batch, epoch, repo_path, now)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
