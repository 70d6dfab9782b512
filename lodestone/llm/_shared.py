"""What the operators share: staged tables in the cluster's shared folder and Arrow block handling."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; one longer document makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Tables that are staged between two collections of the driver's garbage.
SWEEP_EVERY = 2


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, as a row may hold a very long text.

    Results are lazy, so the settings have to hold until these are used; they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    # a join of texts with a few chosen ids first drops, by a Bloom filter, most texts that aren't chosen
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


@contextmanager
def small_plans(spark: SparkSession) -> Iterator[None]:
    """For many steps over tables of bounded size, whose results are written within the block: no code is generated for
    them and few partitions are made. The settings are put back at the end."""
    wanted = {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where there is one machine, may do without the setting (tests) and gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _own_dirs:
        _own_dirs[own] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own_dirs[own]


_own_dirs: dict[str, str] = {}
#: Folders written by this process and not deleted yet.
_written: list[str] = []
#: Tables staged by this process.
_count = itertools.count(1)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str, short: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, and lost executors lose nothing.

    The table stays, as results may read it; release() deletes it. A table of `short` rows is written in an eighth of
    the files, each by one task that goes through its partitions in turn; every file costs a store some requests.
    """
    return _stage(df, work_path(df.sparkSession, name), short)


def _stage(df: DataFrame, path: str, short: bool) -> DataFrame:
    if short:
        df = df.coalesce(max(8, -(-n_partitions(df.sparkSession) // 8)))
    df.write.parquet(path)
    if next(_count) % SWEEP_EVERY == 0:
        sweep(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark drops shuffle files and broadcasts only when it sees that no plan is left
    which reads them, and an operator of many short steps leaves many plans before the heap happens to be full."""
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all that operators have written in the shared folder; for when their results aren't read any more."""
    for path in list(_written):
        delete(spark, path)


class Scratch:
    """Staged tables that no result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str, short: bool = False) -> DataFrame:
        self.paths.append(work_path(self.spark, name))
        return _stage(df, self.paths[-1], short)

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys of which each goes to another of n hash partitions."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")
    found = spark.range(0, 40 * n + 1000, 1, 1).select("id", place).groupBy("place").agg(
        F.min("id").alias("key")
    ).collect()
    return [int(r["key"]) for r in sorted(found)]


def carried(columns: list[str], results: list[str]) -> Column:
    """The columns as one struct, without those named like a result, whose names then clash with nothing in between."""
    taken = {r.lower() for r in results}
    return F.struct(*[F.col(f"`{c}`") for c in columns if c.lower() not in taken])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and n + 1 offsets into them."""
    wide = isinstance(texts, pa.LargeStringArray)
    offsets = np.frombuffer(
        texts.buffers()[1], np.int64 if wide else np.int32
    )[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows: first row, end row, bytes, offsets."""
    data, offsets = flat(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
