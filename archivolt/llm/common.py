"""Shared helpers: scratch tables, shares of a hash, plain columns."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent in a local session, as in tests, a
    temporary folder of this machine takes its place; on a cluster that is an
    error, as executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_folder, "local"):
        shared_folder.local = "file://" + tempfile.mkdtemp(prefix="archivolt-")
    return shared_folder.local


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without computing df again, and df is computed once however often it is
    read. The table is removed by `drop`, or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/archivolt-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more, and the shuffle files of finished jobs.

    Spark frees shuffle files once the driver has collected their handles as
    garbage, which a large driver heap does late; so it is asked to do it here.
    """
    discard(*tables)
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.scratch_path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added to those that are taken."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, per_block: int) -> int:
    """How many blocks hold rows, each of per_block rows on average at most."""
    return max(1, math.ceil(rows / per_block))


def share(column: str | Column, parts: int) -> Column:
    """An even share 0..parts-1 of a column by its hash; null goes to 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.xxhash64(c), F.lit(parts)), F.lit(0)).cast("int")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column written as text, modulo modulus; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)).cast("int")
