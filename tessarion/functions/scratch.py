"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship_package


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset (tests, one machine) a temporary folder is set; on a cluster that is an error,
    because a machine-local folder would lose the data of other machines.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessarion-"))
    return sc.getCheckpointDir()


_left: dict[str, tuple] = {}


@atexit.register
def clear() -> None:
    """Remove what this application wrote, when it ends: no frame reads it any more."""
    for path, fs in _left.values():
        with contextlib.suppress(Exception):  # the session's process may be gone, and its folder with it
            fs.delete(path, True)
    _left.clear()


#: Bytes of a stored table whose steps are taken at once, and from which on the shuffles behind one are removed at once.
SLICE, SETTLE = 128 << 20, 16 << 20


def stored_size(df: DataFrame) -> int:
    """Bytes of the files that a frame reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # a frame without files has no size, which Catalyst takes for a huge one


def in_slice(column: str, k: int, n: int) -> Column:
    """Whether a row is in the k-th of n slices by the hash of a column."""
    return F.pmod(F.xxhash64(column), F.lit(n)) == k if n > 1 else F.lit(True)


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and carry their size.

    The written size lets Catalyst decide on broadcasts by ``autoBroadcastJoinThreshold``.  ``drop`` removes
    what no later step reads; the rest goes when the application ends, since results read it until then.
    ``lean`` is for tables as large as the input: they are packed tighter, and the shuffles behind a large one go
    as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark = spark
        self.lean = lean
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        _left[self.root] = (path, path.getFileSystem(spark._jsc.hadoopConfiguration()))
        ship_package(spark)

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        return self.sliced(lambda k: df, 1, tag)

    def sliced(self, make: Callable[[int], DataFrame], n: int, tag: str) -> DataFrame:
        """The rows of make(0) to make(n - 1) as one table, written one after the other: the shuffles of one are on disk at a time."""
        path = self.path(tag)
        for k in range(n):
            df = make(k)
            (df.write.mode("append").option("compression", "zstd") if self.lean else df.write.mode("append")).parquet(path)
            schema = df.schema
            del df
            if self.lean:
                self.settle(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def settle(self, path: str) -> None:
        """Spark removes shuffles that nothing reads any more when the driver collects its garbage, which it may not do for long."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(fs_path).getLength() > SETTLE:
            gc.collect()
            self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
