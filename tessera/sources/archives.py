"""Tar archives as a data source: read, streamed, and written with a commit.

    archives.register(spark)
    df.select("name", "data").write.format("archives").mode("append").save(path)
    spark.read.format("archives").load(path).where("name like 'web/%'")
    spark.readStream.format("archives").load(path)

Rows are the regular files of `*.tar`, `*.tar.gz` and `*.tgz`: name, data, size,
archive (file name) and place (from 0, counting all members). With a schema of fewer
columns only those are made; members that a pushed filter on `name` or `archive`
leaves out, and all without `data`, are passed over by a seek (gzip: decompressed,
not kept). An archive is read by one task, a member at a time.

A task writes its rows to files of its own under new names and begins another at
`archiveBytes` (256 MB unless given). What is in the table is what the commits in
`_commits` list, one small file each, which appears by a rename: files of tasks that
failed, ran twice, or whose job ended before its commit aren't read. Overwriting is
a commit before which nothing counts. A batch of a stream that was committed before
(the option `writer` names the stream) isn't committed again. One writer at a time;
a folder without `_commits` is read whole. A stream takes commits in their order,
at most `commitsPerBatch` at once (16 unless given), overwriting ones as appended.

Names are not null or empty, hold no NUL and don't end in "/"; data isn't null:
else an error. data may be text, written as UTF-8. Equal names are kept as rows each.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

SCHEMA = "name string, data binary, size long, archive string, place long"
ENDINGS = (".tar", ".tar.gz", ".tgz")
COMMITS = "_commits"

#: How a pushed filter is answered from one value. A null value passes none.
TESTS: dict[type, Callable[[Any, Any], bool]] = {
    D.EqualTo: lambda v, w: v == w,
    D.In: lambda v, w: v in w,
    D.StringStartsWith: lambda v, w: v.startswith(w),
    D.StringEndsWith: lambda v, w: v.endswith(w),
    D.StringContains: lambda v, w: w in v,
}


def _passes(value: str, tests: list[D.Filter]) -> bool:
    return all(TESTS[type(t)](value, t.value) for t in tests)


@dataclass
class Folder:
    """A folder of archives and its commits."""

    path: str

    def __post_init__(self) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def __reduce__(self):
        return Folder, (self.path,)

    def at(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _listed(self, *parts: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.at(*parts), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def commits(self) -> list[str]:
        return [name for name in self._listed(COMMITS) if name.endswith(".json")]

    def commit(self, name: str) -> dict:
        with self.fs.open_input_stream(self.at(COMMITS, name)) as f:
            return json.loads(f.read())

    def archives(self) -> list[str]:
        commits = self.commits()
        if not commits:
            return [name for name in self._listed() if name.endswith(ENDINGS)]
        found: list[list[str]] = []
        for name in reversed(commits):
            made = self.commit(name)
            found.append(made["archives"])
            if made["overwrites"]:
                break
        return [a for some in reversed(found) for a in some]

    def publish(self, archives: list[str], overwrites: bool, batch: str | None = None) -> bool:
        """Make archives part of the table; False if this batch of a stream is already."""
        commits = self.commits()
        if batch is not None and any(name.endswith(f".{batch}.json") for name in commits):
            return False
        self.fs.create_dir(self.at(COMMITS))
        number = 1 + int(commits[-1].split(".")[0]) if commits else 0
        name = f"{number:010}.{batch}.json" if batch is not None else f"{number:010}.json"
        hidden = self.at(COMMITS, f"{name}.{uuid.uuid4().hex}")
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps({"archives": archives, "overwrites": overwrites}).encode())
        self.fs.move(hidden, self.at(COMMITS, name))
        return True

    def remove(self, archives: Iterable[str]) -> None:
        for name in archives:
            if self.fs.get_file_info(self.at(name)).type == fs.FileType.File:
                self.fs.delete_file(self.at(name))


@dataclass
class Archive(D.InputPartition):
    name: str


class Reader(D.DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType) -> None:
        self.folder, self.columns = folder, schema.fieldNames()
        self.of_name: list[D.Filter] = []
        self.of_archive: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Take those on name and archive; Spark applies the rest."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("name",), ("archive",)):
                (self.of_name if f.attribute == ("name",) else self.of_archive).append(f)
            elif not (isinstance(f, D.IsNotNull) and f.attribute in (("name",), ("archive",))):  # neither is ever null
                yield f

    def partitions(self) -> list[Archive]:
        return [Archive(a) for a in self.folder.archives() if _passes(a, self.of_archive)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.name:
            return
        with self.folder.fs.open_input_file(self.folder.at(partition.name)) as f, tarfile.open(fileobj=f, mode="r:" if partition.name.endswith(".tar") else "r|gz") as tar:
            for place, member in enumerate(tar):
                tar.members = []  # it keeps all that it has met
                if member.isreg() and _passes(member.name, self.of_name):
                    made = {"name": member.name, "size": member.size, "archive": partition.name, "place": place}
                    if "data" in self.columns:
                        made["data"] = tar.extractfile(member).read()
                    yield tuple(made[c] for c in self.columns)


class StreamReader(D.DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def __init__(self, folder: Folder, schema: StructType, per_batch: int) -> None:
        self.reader, self.folder, self.per_batch, self.seen = Reader(folder, schema), folder, per_batch, 0

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        self.seen = min(len(self.folder.commits()), self.seen + self.per_batch)
        return {"commits": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Archive]:
        self.seen = max(self.seen, end["commits"])  # after a restart, go on from the last batch
        return [Archive(a) for name in self.folder.commits()[start["commits"] : end["commits"]] for a in self.folder.commit(name)["archives"]]

    def read(self, partition: Archive) -> Iterator[tuple]:
        return self.reader.read(partition)


@dataclass
class Written(D.WriterCommitMessage):
    archives: list[str]


class TaskWriter:
    """Writes one task's rows."""

    def __init__(self, folder: Folder, archive_bytes: int) -> None:
        self.folder, self.archive_bytes = folder, archive_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        made: list[str] = []
        out = tar = None
        try:
            for batch in batches:
                for name, data in zip(batch.column("name"), batch.column("data"), strict=True):
                    if tar is None:
                        made.append(f"part-{uuid.uuid4().hex}.tar")
                        out = self.folder.fs.open_output_stream(self.folder.at(made[-1]))
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                    _add(tar, name.as_py(), data.as_py())
                    if tar.offset >= self.archive_bytes:
                        tar.close()
                        out.close()
                        tar = None
            if tar is not None:
                tar.close()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            self.folder.remove(made)
            raise
        return Written(made)


def _add(tar: tarfile.TarFile, name: str | None, data: bytes | str | None) -> None:
    if not name or "\0" in name or name.endswith("/"):
        raise ValueError(f"not a name of a member: {name!r}")
    if data is None:
        raise ValueError(f"no data: {name!r}")
    raw = data.encode() if isinstance(data, str) else bytes(data)
    member = tarfile.TarInfo(name)
    member.size = len(raw)
    tar.addfile(member, io.BytesIO(raw))
    tar.members = []


class Writer(D.DataSourceArrowWriter):
    def __init__(self, folder: Folder, archive_bytes: int, overwrites: bool) -> None:
        self.folder, self.overwrites, self.task = folder, overwrites, TaskWriter(folder, archive_bytes)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.task.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.publish([a for m in messages if m for a in m.archives], self.overwrites)

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.remove(a for m in messages if m for a in m.archives)


class StreamWriter(D.DataSourceStreamArrowWriter):
    def __init__(self, folder: Folder, archive_bytes: int, overwrites: bool, name: str) -> None:
        self.folder, self.overwrites, self.name, self.task = folder, overwrites, name, TaskWriter(folder, archive_bytes)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.task.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        made = [a for m in messages if m for a in m.archives]
        if not self.folder.publish(made, self.overwrites, f"{self.name}-{batchId}"):
            self.folder.remove(made)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.folder.remove(a for m in messages if m for a in m.archives)


class Archives(D.DataSource):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if "path" not in options:
            raise ValueError("archives: give the folder as the path")
        self.folder = Folder(options["path"])
        self.archive_bytes = int(options.get("archiveBytes", 256 << 20))

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.folder, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.folder, schema, int(self.options.get("commitsPerBatch", 16)))

    def _ready(self, schema: StructType) -> Folder:
        if set(schema.fieldNames()) != {"name", "data"}:
            raise ValueError(f"archives are written from the columns name and data, not {schema.fieldNames()}")
        self.folder.fs.create_dir(self.folder.root)
        return self.folder

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self._ready(schema), self.archive_bytes, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        name = self.options.get("writer", "stream")
        if not name.replace("_", "").isalnum():
            raise ValueError(f"writer: letters, digits and _ only, not {name!r}")
        return StreamWriter(self._ready(schema), self.archive_bytes, overwrite, name)


def register(spark: SparkSession) -> None:
    """Make the format "archives" known to the session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
