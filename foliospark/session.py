"""Session helpers: tables, checkpoints and bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of ``spark``, once a context, so that they need no path to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="foliospark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only on one machine (tests) a new one takes its place where
    that is unset; on a cluster a local folder would be lost with its machine, so that it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliospark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, which cuts its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def written(df: DataFrame) -> DataFrame:
    """Like checkpoint, as a compressed columnar table in the shared folder: smaller, and later reads take the columns
    they need. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs far more than moving its input.

    Large tables have more partitions than that and stay as they are; a table of one small file would be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of files, compressed as they are, that one partition behind by_key should hold.
PARTITION_BYTES = 48 * 1024 * 1024


def _file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads. Checkpoints count nothing: they carry the estimate of the plan that they were,
    which joins may have multiplied beyond any use."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    nodes = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(x.stats().sizeInBytes()) for x in nodes if x.getClass().getSimpleName() == "LogicalRelation")


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by keys into a fixed number of partitions, for work in Python behind the shuffle: adaptive execution
    would join small partitions by their bytes, though their work is long. The number is that of
    ``spark.sql.shuffle.partitions``, of cores, or of PARTITION_BYTES in the files that are read, whichever is most."""
    spark = df.sparkSession
    cores, usual = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(cores, usual, _file_bytes(df) // PARTITION_BYTES), *keys)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffle join.

    Counts ``df``, so give it a checkpointed or small plan.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
