"""Files of exact names, plain or zipped, one for each path that the rows name, written by the tasks that hold the rows.

A Python data source writes the rows (path, grp, text) of a partition, which must be sorted by path and grp, to a folder
of its own below the root; the job's commit moves the files to their places and removes those whose rows are all null,
and an abort removes the folder, so a failing task leaves nothing. Paths are opened through pyarrow's file systems.
"""

from __future__ import annotations

import contextlib
import dataclasses
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SOURCE = "citeweave_members"
#: Files moved at a time by the driver.
MOVES = 16


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as Spark would resolve it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, the paths in it, and the paths of which nothing is left."""

    folder: str
    paths: list[str]
    emptied: list[str]


class _Member:
    """One open file: lines, or JSON-LD documents by graph."""

    def __init__(self, store: fs.FileSystem, place: str, name: str, zipped: bool, head: str | None):
        store.create_dir(posixpath.dirname(place), recursive=True)
        self.files = contextlib.ExitStack()
        out = self.files.enter_context(store.open_output_stream(place))
        if zipped:
            out = self.files.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
            out = self.files.enter_context(out.open(name, "w", force_zip64=True))
        self.out, self.head, self.graph, self.first = out, head, None, True

    def add(self, graph: str, text: str) -> None:
        if self.head is None:
            self.out.write(text.encode() + b"\n")
            return
        if self.first or graph != self.graph:
            begin = "[" if self.first else self._end() + ","
            self.out.write((begin + "{" + self.head + '"@graph":[').encode())
        else:
            self.out.write(b",\n")
        self.out.write(text.encode())
        self.first, self.graph = False, graph

    def _end(self) -> str:
        return '],"@id":' + json.dumps(self.graph, ensure_ascii=False) + "}"

    def close(self) -> None:
        if self.head is not None:
            self.out.write((self._end() + "]\n").encode())
        self.files.close()


class MemberWriter(DataSourceArrowWriter):
    """Writes rows (path, grp, text); options: root, run, zipped, suffix of zipped members, head of JSON-LD documents."""

    def __init__(self, options: dict[str, str]):
        self.root, self.run = options["root"], options["run"]
        self.zipped, self.suffix, self.head = options["zipped"] == "true", options["suffix"], options.get("head")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.root)
        folder = posixpath.join(root, f"_writing-{self.run}", uuid.uuid4().hex)
        done, emptied = Written(folder, [], []), set()
        path, member = None, None

        def finish() -> None:
            if member is not None:
                member.close()
                done.paths.append(path)
            elif path is not None:
                emptied.add(path)

        for batch in batches:
            for row_path, graph, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row_path != path:
                    finish()
                    path, member = row_path, None
                if text is None:
                    continue
                if member is None:
                    stem = posixpath.basename(path).rsplit(".", 1)[0]
                    member = _Member(store, posixpath.join(folder, path), stem + self.suffix, self.zipped, self.head)
                member.add(graph, text)
        finish()
        done.emptied = sorted(emptied)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.root)
        local = isinstance(store, fs.LocalFileSystem)

        def place(move: tuple[str, str]) -> None:
            source, path = move
            target = posixpath.join(root, path)
            store.create_dir(posixpath.dirname(target), recursive=True)
            if not local:  # where a move doesn't replace
                self._delete(store, target)
            store.move(source, target)

        with ThreadPoolExecutor(MOVES) as pool:
            for message in filter(None, messages):
                list(pool.map(place, [(posixpath.join(message.folder, p), p) for p in message.paths]))
                list(pool.map(lambda p: self._delete(store, posixpath.join(root, p)), message.emptied))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.root))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(posixpath.join(root, f"_writing-{self.run}"))

    @staticmethod
    def _delete(store: fs.FileSystem, path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            store.delete_file(path)


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema: StructType, overwrite: bool) -> MemberWriter:
        return MemberWriter(dict(self.options))


def write_members(rows: DataFrame, root: str, zipped: bool, suffix: str, head: str | None, order: str = "text") -> None:
    """Write rows (path, grp, text and an order) to files below ``root``, each path by one task, in order.

    A null text asks for its path to be removed if no other row names it. head: what JSON-LD documents begin with besides
    their graph; without it the files hold lines. A path's rows pass through its task one by one, however many they are.
    """
    spark = rows.sparkSession
    spark.dataSource.register(MemberSource)
    options = {"root": qualified(spark, root), "run": uuid.uuid4().hex, "zipped": str(zipped).lower(), "suffix": suffix} | ({} if head is None else {"head": head})
    dealt = rows.repartition("path").sortWithinPartitions("path", F.col("text").isNull(), "grp", order)
    dealt.select("path", "grp", "text").write.format(SOURCE).mode("append").options(**options).save()


def member_text(data: bytes, path: str) -> str:
    """A file's text, out of its only member if it is zipped."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as held:
            data = held.read(held.namelist()[0])
    return data.decode()


def read_members(paths: DataFrame, root: str) -> DataFrame:
    """path, content (text) of those files (path, below ``root``) that exist; tasks open the files of their own rows."""
    top = qualified(paths.sparkSession, root)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = file_system(top)
        for frame in frames:
            for path in frame["path"]:
                with contextlib.suppress(FileNotFoundError), store.open_input_stream(posixpath.join(folder, path)) as source:
                    yield pd.DataFrame({"path": [path], "content": [member_text(source.read(), path)]})

    return paths.select("path").distinct().mapInPandas(read, "path string, content string")
