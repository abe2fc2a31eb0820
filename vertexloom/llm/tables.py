"""Reading input tables, scratch tables that survive lost executors, and collision-proof names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset (tests), a local one.

    Only a local master may do without: on a cluster a local folder isn't seen by all executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: A saved table is broadcast up to so many bytes as written and so many rows; a larger one is shuffled.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 400_000


class Scratch:
    """Tables written in the shared folder, so that a lost executor costs no recomputation.

    ``save`` cuts lineage: it writes the frame and reads it again. ``drop`` deletes tables that
    nothing will read any more; those that a returned frame still reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/vertexloom/{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def _at(self, saved: DataFrame):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(saved._scratch_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            fs, path = self._at(df)
            fs.delete(path, True)
        self.spark._jvm.System.gc()  # Spark deletes shuffle files once the driver has collected what they belong to

    def small(self, saved: DataFrame, otherwise: str = "") -> DataFrame:
        """A saved table, broadcast when its bytes and its rows show that it is small.

        ``otherwise`` is a join hint for a large one. Bytes come first: only of a table that is
        small by them are the rows counted.
        """
        fs, path = self._at(saved)
        if fs.getContentSummary(path).getLength() <= BROADCAST_BYTES and saved.count() <= BROADCAST_ROWS:
            return F.broadcast(saved)
        return saved.hint(otherwise) if otherwise else saved


def give_back() -> None:
    """At the end of a Python task: memory that is free goes back to the system.

    Idle workers live on beside later stages, and would otherwise hold what their largest batch took.
    """
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same_row(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))
