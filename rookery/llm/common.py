"""Shared pieces: table reading, shared-folder tables, folds, row batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own where it is unset and the master local, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rookery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/rookery-{uuid.uuid4().hex}/{name}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path).getParent()
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
            return

    atexit.register(remove)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and go on from the files (cuts lineage).

    ``files`` bounds the number of files, for tables of few bytes a row.
    """
    path = new_path(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim_native(spark: SparkSession) -> bool:
    """Give back what the C heaps of the driver's JVM and Python hold of freed memory, as compilers of generated code leave it; False where there is no such way (it is glibc's)."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
        gateway = spark.sparkContext._gateway
        kinds, java = gateway.jvm.java.lang.Class, gateway.jvm.java
        of = gateway.new_array(kinds, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            of[k] = kinds.forName(name)
        args = gateway.new_array(java.lang.Object, 4)
        args[0], args[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the public interface: the server's own class is closed to reflection
        kinds.forName("javax.management.MBeanServer").getMethod("invoke", of).invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  another C library or JVM
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark gives back shuffles and broadcasts of plans that are gone only then, and long loops leave many."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def on_disk(df: DataFrame) -> DataFrame:
    """Keep a result on the executors' disks for its further uses; a lost part is computed again from its inputs."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.DISK_ONLY)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python in batches of ``rows``: single texts may be long, and Arrow buffers hold whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def map_rows(df: DataFrame, schema: str, rows: Callable[[list], list | pa.RecordBatch], *, size: int = 512) -> DataFrame:
    """``mapInArrow`` whose function gets and gives column lists of at most ``size`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                made = rows(batch.slice(at, size))
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(made, out_schema.types)], schema=out_schema)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Memo(dict):
    """A bounded token cache: ``memo[token]`` computes what is missing.

    Keys longer than ``longest`` are not kept: a text without blanks is one.
    Python workers live on from one operator to the next; the caches of one
    ``group`` give way when another group's are filled.
    """

    _filled: list = []

    def __init__(self, make: Callable, most: int = 300_000, group: str | None = None, longest: int = 64):
        super().__init__()
        self.make, self.most, self.group, self.longest = make, most, group or str(id(self)), longest

    def __missing__(self, key):
        if not any(m is self for m in Memo._filled):
            for other in Memo._filled:
                if other.group != self.group:
                    other.clear()
            Memo._filled[:] = [m for m in Memo._filled if m.group == self.group and m is not self] + [self]
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value


def join_groups(rows: DataFrame, about: DataFrame, key: str, count: str, spread: list[str], total: int, *, part: int = 256, most_hubs: int = 1_000_000) -> DataFrame:
    """Inner join of ``rows`` with ``about``, which has one row for each ``key`` and in ``count`` how many of ``rows`` have it.

    A key of more than ``part`` rows (``total / most_hubs``, if that is more) is
    dealt over as many tasks as it has parts, by a hash of ``spread``, and its
    row of ``about`` goes to each.  The broadcast table of such keys has
    ``most_hubs`` rows of two numbers at most, whatever the total.
    """
    part = max(part, -(-total // most_hubs))
    parts = F.ceil(F.col(count) / part).cast("int")
    hubs = about.filter(F.col(count) > part).select(key, parts.alias("_parts"))
    left = rows.join(F.broadcast(hubs), key, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"))).drop("_parts")
    right = about.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), parts - 1))))
    return left.join(right, [key, "_part"]).drop("_part")


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum ``values`` over consecutive runs of ``counts``; empty runs give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
