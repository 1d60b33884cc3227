"""Helpers that the corpus operators share: scratch tables, id remainders, reading tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Return what this process has freed to the system. Spark's Python workers live on after a task, idle ones too, beside the executor."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches whose worker gives its memory back when the task ends."""

    @wraps(task)
    def run(*args, **kwargs) -> Iterator:
        try:
            yield from task(*args, **kwargs)
        finally:
            give_back()

    return run


#: Bits of a sorted row's number that number the rows of its partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``rank``, each row's place from 0 in a total order, over all partitions. Rows are sorted by range and numbered within their
    partition; what reaches the driver is the number of rows of each partition."""
    lined = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    lined = scratch.write(lined, name)
    part = F.shiftright("at", ROW_BITS).alias("part")
    counts = sorted(map(tuple, lined.groupBy(part).count().collect()))
    starts, before = [], 0
    for number, rows in counts:
        starts.append((number, before))
        before += rows
    starts = df.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return lined.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", rank).drop("part", "start", "at")


class Scratch:
    """Tables written to the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a local session) a temporary
    folder is made and set. A written table cuts lineage and outlives lost executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.written: list[str] = []
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet under ``name`` (which must be new) and read it back."""
        path = f"{self.root}/{name}"
        self.written.append(name)
        writer = df.write.mode("errorifexists").option("parquet.block.size", 16 << 20)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """Write ``df`` as a table of ``buckets`` buckets, each sorted by ``keys``; joins on these read it without moving it. If the
        partitions of ``df`` are the buckets, each is one file."""
        table = f"{self.root.rsplit('/', 1)[-1]}_{name}".replace("-", "_")
        self.written.append(name)
        self.tables[name] = table
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.root}/{name}").option("parquet.block.size", 16 << 20).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def tidy(self, *kept: str) -> None:
        """Delete all tables but those whose names start with one of ``kept``."""
        for name in self.written:
            if not name.startswith(kept):
                self.drop(name)
        self.written = [name for name in self.written if name.startswith(kept)]

    def posix(self, name: str) -> str:
        """The folder ``name`` as a path that workers can open and map; the shared folder must be mounted for that."""
        root = self.root
        for scheme in ("file://", "file:"):
            if root.startswith(scheme):
                root = root[len(scheme):]
                break
        if "://" in root:
            raise ValueError(f"memory-mapped files need a mounted shared folder, not {self.root}")
        return f"{root}/{name}"
