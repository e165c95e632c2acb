"""Sinks: idempotent upserts, immutable and content-addressed writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.integrity import latest
from foliospark.session import checkpoint


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys. ``new`` should have each key once; null keys
    match nothing and are added.

    With ``order`` the last row of each key over both sides stays, so that a row that comes late changes nothing; a key
    may then be repeated on either side, and null keys count as a value.
    """
    if order is not None:
        return latest(old.unionByName(new), keys, order).select(*old.columns)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _fs(spark: SparkSession, path: str):
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


#: Parts of an upserted table by the hash of its keys: an upsert rewrites only those that its rows fall into.
BUCKETS = 32
#: The file that lists a table's current folders. It is replaced by one rename, so that readers see all of a write or none.
_POINTER = "_CURRENT"


def _listed(spark: SparkSession, path: str) -> dict[str, str]:
    """Bucket to folder of a table as last committed; empty if there is none."""
    fs, target = _fs(spark, f"{path}/{_POINTER}")
    if not fs.exists(target):
        return {}
    stream = fs.open(target)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    fresh = f"{path}/{_POINTER}.{uuid.uuid4().hex}"
    fs, target = _fs(spark, fresh)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(target, _fs(spark, f"{path}/{_POINTER}")[1], overwrite)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written by swap_write or upsert, as of its last commit; None if there is none."""
    folders = sorted(set(_listed(spark, path).values()))
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes folders that no commit lists any more. Readers of an older state fail, so run it when there are none."""
    fs, target = _fs(spark, path)
    kept = {*(f.split("/")[0] for f in _listed(spark, path).values()), _POINTER}
    for status in fs.listStatus(target):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def swap_write(df: DataFrame, path: str) -> None:
    """Replaces a table by one rename after it has been written in full: readers (read_table) see the old rows or the
    new ones, and a query may read the table it replaces."""
    folder = f"all-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(df.sparkSession, path, {"": folder})


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Upsert into a table, which is made if it doesn't exist. Running it twice changes nothing; with ``order`` a late
    row changes nothing either.

    The table lies in ``buckets`` folders by the hash of its keys. Those that ``new`` has no rows for are neither read nor
    written; an empty ``new`` writes nothing. ``keys`` and ``buckets`` must stay the same for a table.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = checkpoint(latest(new, keys, order).select(*new.columns) if order else new)
    touched = [r["b"] for r in new.select(at.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    folders = _listed(spark, path)
    old = sorted({folders[str(b)] for b in touched if str(b) in folders})
    rows = upserted(spark.read.schema(new.schema).parquet(*[f"{path}/{f}" for f in old]), new, keys, order) if old else new
    fresh = uuid.uuid4().hex
    rows.withColumn("bucket", at).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{fresh}")
    _commit(spark, path, folders | {str(b): f"{fresh}/bucket={b}" for b in touched})


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order: count, sum and exclusive or of row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    r = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{(r['x'] or 0) & (1 << 64) - 1:016x}-{int(r['s'] or 0) & (1 << 64) - 1:016x}"


def write_once(df: DataFrame, path: str) -> bool:
    """Writes an immutable table: True if it was written, False if the same rows are there; other rows are an error."""
    fs, target = _fs(df.sparkSession, path)
    if fs.exists(target):
        if content_digest(df.sparkSession.read.parquet(path)) != content_digest(df):
            raise FileExistsError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def freeze(df: DataFrame, folder: str) -> str:
    """Writes a table under its content's digest and gives the path."""
    path = f"{folder}/snap-{content_digest(df)}"
    write_once(df, path)
    return path


def append_snapshot(sessions: DataFrame, candidates: DataFrame, folder: str) -> None:
    """Appends a search's sessions (one row a query, with its configuration) and their ranked candidates."""
    candidates.write.mode("append").parquet(f"{folder}/candidates")
    sessions.write.mode("append").parquet(f"{folder}/sessions")
