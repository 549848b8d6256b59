"""Changes of several tables that become visible together: staged folders and one manifest for each commit."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


class Conflict(RuntimeError):
    """Another writer committed first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole unless its path is taken; whether it was written.

    The file is written under another name and then named, in one step that fails where the name is taken: a hard link on local
    disks (which the driver and executors share if the path does), a rename elsewhere, which file systems of the Hadoop kind refuse
    to do onto an existing file.  A writer that dies leaves at most the other name.
    """
    jvm = spark._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            import os

            try:
                os.link(staged.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(staged, target)
    finally:
        fs.delete(staged, False)


class ChangeSets:
    """A folder of tables as logs of changes: every commit adds rows to some of them, and a snapshot has the last row of each id.

    A commit writes its rows to a folder of its own and then puts a manifest with the next number.  Readers see manifests alone, so what a
    writer left without one does not exist; of two writers of a number the second gets a ``Conflict`` and reads again.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _manifests(self, upto: int | None) -> list[dict]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if n.endswith(".json"))
        if upto is not None:
            names = [n for n in names if int(n[:-5]) <= upto]
        out = [json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{n}").collect())) for n in names]
        last = max((i for i, m in enumerate(out) if m["whole"]), default=0)
        return out[last:]  # a whole one replaces all before it

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((m["version"] for m in self._manifests(None)), default=0)

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write rows of some tables where no reader looks; the folders, for ``publish``."""
        folders = {}
        for name, df in tables.items():
            fields = StructType.fromDDL(self.schemas[name])
            folders[name] = f"{self.root}/data/{uuid.uuid4().hex}/{name}"
            df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(folders[name])
        return folders

    def publish(self, folders: dict[str, str], base: int, whole: bool = False) -> int:
        """Make staged folders visible, all at once, as the commit after ``base``; its number."""
        version = base + 1
        if not put_if_absent(self.spark, f"{self.root}/manifests/{version:012d}.json", json.dumps({"version": version, "whole": whole, "folders": folders})):
            raise Conflict(f"version {version} was committed by another writer")
        return version

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Stage and publish ``tables`` on top of version ``base``, that is of what the caller has read (by default the last)."""
        base = self.version() if base is None else base
        return self.publish(self.stage(tables), base)

    def changes(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table's log up to ``version``, with the number of their commit."""
        out = self.spark.createDataFrame([], f"{self.schemas[table]}, version long")
        for m in self._manifests(version):
            if table in m["folders"]:
                out = out.unionByName(self.spark.read.schema(self.schemas[table]).parquet(m["folders"][table]).withColumn("version", F.lit(m["version"]).cast("long")))
        return out

    def snapshot(self, table: str, version: int | None = None) -> DataFrame:
        """The last row of each id up to ``version`` (by default the last)."""
        order = Window.partitionBy("id").orderBy(F.desc("version"))
        return self.changes(table, version).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "version")

    def compact(self) -> int:
        """Replace the log by one commit with the last row of each id, so that readers open one folder a table."""
        base = self.version()
        return self.publish(self.stage({t: self.snapshot(t, base) for t in self.schemas}), base, whole=True)
