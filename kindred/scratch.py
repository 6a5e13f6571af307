"""Tables that long plans store on their way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared checkpoint folder; they cut lineage and outlive lost executors.

    A local session without such a folder gets one of its own, which goes when Python ends; a cluster must name one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="kindred-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/kindred-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Writes a table and reads it again; the shuffle files of its plan go once it is written."""
        self.n += 1
        path, before = f"{self.root}/{self.n}", self.spark.conf.get(CLEANUP, None)
        try:
            self.spark.conf.set(CLEANUP, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kindred_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._kindred_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
