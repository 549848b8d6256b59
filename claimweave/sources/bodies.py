"""Raw bodies as objects of their own: a data source whose writer never overwrites, for any number of writers at once."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, body binary"


class Store:
    """Objects under a root: put whole and once, read, deleted.  ``file`` roots use links; others the rename of their file system, which must refuse taken names."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def _at(self, path: str) -> str:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"a raw document's path must lie under its root: {path}")
        return f"{self.root}/{path}"

    def put(self, path: str, body: bytes) -> bool:
        """Whether ``body`` was written to ``path``; False if the name is taken.  Readers see whole bodies alone."""
        target = self._at(path)
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        for folder in (os.path.dirname(target), f"{self.root}/_staged"):
            self.fs.create_dir(folder, recursive=True)
        with self.fs.open_output_stream(staged) as out:
            out.write(body)
        try:
            if self.local:
                os.link(staged, target)
            else:
                self.fs.move(staged, target)
        except OSError:
            if self.get(path) is None:
                raise
            return False
        finally:
            if self.local:
                os.unlink(staged)
        return True

    def get(self, path: str) -> bytes | None:
        from pyarrow import fs

        if self.fs.get_file_info(self._at(path)).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(self._at(path)) as f:
            return f.read()

    def delete(self, path: str) -> None:
        if self.get(path) is not None:
            self.fs.delete_file(self._at(path))

    def names(self) -> list[str]:
        from pyarrow import fs

        there = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        names = (f.path[len(self.root) :].lstrip("/") for f in there if f.type == fs.FileType.File)
        return sorted(n for n in names if not n.startswith("_"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has put, by the name of the list that it wrote of it: the driver holds names of lists, not of bodies."""

    log: str
    made: int
    same: int


class BodiesWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator):
        """Put each body; a taken path is an error, unless its body is the same: then a retried task or another writer was first."""
        store, made, same = Store(self.root), [], 0
        log = f"_jobs/{self.job}/{uuid.uuid4().hex}"
        try:
            for row in iterator:
                body = bytes(row.body)
                if store.put(row.path, body):
                    made.append(row.path)
                elif store.get(row.path) == body:
                    same += 1
                else:
                    raise ValueError(f"a raw document of this path exists: {row.path}")
        except BaseException:
            for path in made:
                store.delete(path)
            raise
        store.put(log, "\n".join(made).encode())
        return Written(log, len(made), same)

    def commit(self, messages):
        """Tell of the job in one file, whose presence says that it is whole."""
        told = [m for m in messages if m is not None]
        Store(self.root).put(f"_jobs/{self.job}/_done", json.dumps({"made": sum(m.made for m in told), "same": sum(m.same for m in told)}).encode())

    def abort(self, messages):
        """Take back what the tasks that ended have put."""
        store = Store(self.root)
        for m in messages:
            if m is not None:
                for path in (store.get(m.log) or b"").decode().splitlines():
                    store.delete(path)


@dataclass
class Some(InputPartition):
    names: list[str]


class BodiesReader(DataSourceReader):
    def __init__(self, root: str, each: int):
        self.root, self.each = root, each

    def partitions(self):
        names = Store(self.root).names()
        return [Some(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Some([])]

    def read(self, partition):
        store = Store(self.root)
        for name in partition.names:
            yield name, store.get(name)


class Bodies(DataSource):
    """``spark.dataSource.register(Bodies)``, then ``format("raw_bodies")`` with the option ``path`` reads and appends (path, body).

    Each body is an object of its own under the root.  Of two writers of a path one wins: the other is an error, unless it brings the same
    body, as paths that end in the body's hash always do.  A job that fails takes back what it has put.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_bodies"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("raw documents are never overwritten")
        return BodiesWriter(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return BodiesReader(self.options["path"], int(self.options.get("bodiesPerTask", "1000")))


def body_hash(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()
