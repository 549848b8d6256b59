"""Tables written in the folder that all executors share, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in a session of one process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="claimweave-"))
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_in(df: DataFrame) -> DataFrame:
    """``df`` as a side of the next join, which is one by a sort: it grows with the input, and is never sent through the driver.

    Spark takes a table that is read for as large as its compressed files, some twenty times less than its rows in memory.
    """
    return df.hint("merge")


#: Rows of a few short columns that a task of a dealt table reads.
DEALT = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt out by ``keys`` so that a task reads about DEALT of them, however many there are; as it is, if the session's partitions do that."""
    parts = -(-rows // DEALT)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in parts by ``keys``, as many as the session has or more, of about half of DEALT rows at most.  A later grouping by ``keys``
    and more is made in these parts alone: a task that reads has no table of its groups, and none has one that grows with the input."""
    parts = -(-2 * df.count() // DEALT)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


_KEPT: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table's file or folder was changed, and its length: another table under one path has another state."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.getModificationTime(), status.getLen()


def kept(spark: SparkSession, name: str, inputs: list[str], make) -> DataFrame:
    """The table that ``make()`` gives, written once for each application and state of its ``inputs`` (paths)."""
    key = (spark.sparkContext.applicationId, name, *((p, *_state(spark, p)) for p in inputs))
    if key not in _KEPT:
        _KEPT[key] = written(make())
    return _KEPT[key]
