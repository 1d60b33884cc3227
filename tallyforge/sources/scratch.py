"""Tables written once to the folder that driver and executors share, and read by later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a written table beyond which joins shuffle it. Spark takes the compressed size for the size, so it would bring far more to the driver.
LARGE = 1 << 20


class Store:
    """Named tables of one session under ``spark.checkpoint.dir`` (a temporary folder where that is unset)."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        """A new folder's path, for files that are no tables."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, which ends its lineage, and read it back. A large table is never broadcast."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        return read.hint("merge") if self.size(path) > LARGE else read

    def size(self, path: str) -> int:
        """Bytes of a folder's files."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return files.getContentSummary(where).getLength()
