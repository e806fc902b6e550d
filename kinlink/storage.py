"""Intermediate tables in the folder that the cluster shares.

A table written and read again cuts the lineage and survives the loss of executors, which a local
checkpoint or a cached block does not.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: With this, the shuffle files of a finished plan go at once instead of when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of local sessions by application, where the setting is unset.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session in one process (master ``local[...]``) gets a folder of its own that
    goes with it; on a cluster it is an error, since executors do not see each other's disks.
    """
    found = spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        path = "file://" + tempfile.mkdtemp(prefix="kinlink-")
        _delete_on_exit(spark, path)
        _LOCAL[context.applicationId] = path
    return _LOCAL[context.applicationId]


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: Folders made inside each open ``scratch``.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written in it; what is still needed then has its path from before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds one setting of the session, and puts back what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there; its shuffle files go with the job."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Writes ``df``, in one folder for each value of ``by`` if given."""
    with setting(df.sparkSession, TIDY, "true"):
        (df.write.partitionBy(by) if by else df.write).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
