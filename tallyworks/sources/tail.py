"""Streaming source that tails JSONL files.

Spark's file source takes a file once; logs grow. A batch takes, of each file that changed, the lines whose end
lies in the bytes that came since the last batch: an unfinished line waits, and is read from its beginning
once it is whole. A file that was replaced, or has shrunk, is read from its start. The new bytes of a file
are cut into ranges that tasks read in parallel; nothing but tasks opens a file.

What has been taken stands in a state folder: a table of changes for each batch, written before the batch, and
from time to time one of all files. An offset is the number of the last table, however many files there are,
and a restart knows all of them: a file that has not changed is never opened. ``maxFiles`` bounds a batch
to so many files, the oldest first; the others follow in the next ones.

Files are listed, by one process, and read through Arrow's file systems (local paths, hdfs://, s3://, gs://), as
a source's workers have no way to those of the JVM. On stores without inodes 0 stands for them; growth and
shrinking still show in the size.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 20
SPLIT = 64 << 20
#: Tables of changes from which one of all files is written.
COMPACT = 10
CHANGE = pa.schema([("path", pa.string()), ("inode", pa.int64()), ("start", pa.int64()), ("done", pa.int64()), ("modified", pa.int64())])


class Range(InputPartition):
    """The lines of a file that end in [start, end)."""

    def __init__(self, file: str, start: int, end: int, modified: int):
        self.file, self.start, self.end, self.modified = file, start, end, modified


def file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), os.path.abspath(root))


def line_start(f: pa.NativeFile, at: int) -> int:
    """Where the line begins that byte ``at`` belongs to."""
    while at > 0:
        lo = max(0, at - CHUNK)
        f.seek(lo)
        found = f.read(at - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        at = lo
    return 0


def lines_in(fs: arrow_fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that end in a range; the first one may begin before it."""
    with fs.open_input_file(part.file) as f:
        at = begin = line_start(f, part.start)
        f.seek(begin)
        rest = b""
        while begin < part.end:
            chunk = f.read(min(CHUNK, part.end - begin))
            if not chunk:
                return
            begin += len(chunk)
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1


class State:
    """The tables of a state folder: changes by number, and all files up to a number."""

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)

    def numbers(self, kind: str) -> list[int]:
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(i.base_name.split("-")[1].split(".")[0]) for i in found if i.is_file and i.base_name.startswith(f"{kind}-"))

    def name(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}-{number:020d}.parquet"

    def write(self, kind: str, number: int, rows: list[dict]) -> None:
        self.fs.create_dir(self.folder)
        beside = f"{self.folder}/.{uuid.uuid4().hex}"
        pq.write_table(pa.Table.from_pylist(rows, CHANGE), beside, filesystem=self.fs)
        self.fs.move(beside, self.name(kind, number))

    def read(self, kind: str, number: int) -> list[dict]:
        return pq.read_table(self.name(kind, number), filesystem=self.fs).to_pylist()

    def load(self) -> tuple[int, dict[str, dict]]:
        """The last number, and each file as it was taken then."""
        whole = self.numbers("files")
        number = whole[-1] if whole else 0
        files = {r["path"]: r for r in self.read("files", number)} if whole else {}
        for n in (n for n in self.numbers("changes") if n > number):
            files |= {r["path"]: r for r in self.read("changes", n)}
            number = n
        return number, files

    def compact(self, number: int) -> None:
        """One table of all files up to a number whose batch is done; the tables before it go."""
        changes = [n for n in self.numbers("changes") if n <= number]
        if len(changes) < COMPACT:
            return
        whole = self.numbers("files")
        files = {r["path"]: r for r in self.read("files", whole[-1])} if whole else {}
        for n in changes:
            files |= {r["path"]: r for r in self.read("changes", n)}
        self.write("files", changes[-1], list(files.values()))
        for kind, old in (("files", whole), ("changes", changes)):
            for n in old:
                self.fs.delete_file(self.name(kind, n))


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, name: str, state: str, split: int = SPLIT, max_files: int | None = None):
        self.root, self.name, self.split, self.max_files = root, name, split, max_files
        self.folder = state
        self.known: tuple[int, dict[str, dict]] | None = None

    def initialOffset(self) -> dict:
        return {"number": 0}

    def changed(self, files: dict[str, dict]) -> list[dict]:
        """Files that are not as they were taken, the oldest first."""
        fs, root = file_system(self.root)
        local = isinstance(fs, arrow_fs.LocalFileSystem)
        out = []
        for info in fs.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not fnmatch.fnmatch(info.base_name, self.name) or (local and os.path.islink(info.path)):
                continue
            try:
                inode = os.stat(info.path).st_ino if local else 0
            except OSError:
                continue
            before = files.get(info.path)
            start = before["done"] if before and before["inode"] == inode and info.size >= before["done"] else 0
            if info.size > start or (before and start < before["done"]):
                out.append({"path": info.path, "inode": inode, "start": start, "done": info.size, "modified": (info.mtime_ns or 0) // 1000})
        return sorted(out, key=lambda r: (r["modified"], r["path"]))

    def latestOffset(self) -> dict:
        number, files = self.known or State(self.folder).load()
        some = self.changed(files)[: self.max_files]
        if some:
            number += 1
            State(self.folder).write("changes", number, some)
            files |= {r["path"]: r for r in some}
        self.known = number, files
        return {"number": number}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # of a file that was read from its start again only what came then is there
        ranges: dict[str, dict] = {}
        for n in range(start["number"] + 1, end["number"] + 1):
            for r in State(self.folder).read("changes", n):
                before = ranges.get(r["path"])
                ranges[r["path"]] = r | {"start": before["start"]} if before and r["start"] == before["done"] and r["inode"] == before["inode"] else r
        return [Range(r["path"], lo, min(lo + self.split, r["done"]), r["modified"]) for r in ranges.values() for lo in range(r["start"], r["done"], self.split)]

    def read(self, part: Range) -> Iterator[tuple]:
        fs, _ = file_system(self.root)
        modified = datetime.fromtimestamp(part.modified / 1e6, timezone.utc)
        for at, line in lines_in(fs, part):
            yield part.file, at, line.decode("utf-8", "replace").rstrip("\r\n"), modified

    def commit(self, end: dict) -> None:
        State(self.folder).compact(end["number"])


class JsonlTail(DataSource):
    """``spark.dataSource.register(JsonlTail)``, then ``readStream.format("jsonl_tail").option("state", folder).load(root)``.

    Options: state (a folder of this stream alone, as lasting as its checkpoint), glob (of file names), split
    (bytes of a range), maxFiles (of a batch).
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, offset long, line string, modified timestamp"

    def streamReader(self, schema) -> TailReader:
        most = self.options.get("maxFiles")
        return TailReader(self.options["path"], self.options.get("glob", "*.jsonl"), self.options["state"], int(self.options.get("split", SPLIT)), int(most) if most else None)
