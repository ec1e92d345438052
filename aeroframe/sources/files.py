"""A sink of whole files: one row a file, written by the tasks, made visible by the commit.

``df.write.format("aeroframe_files").mode("overwrite").save(folder)`` takes rows of
(name, content). A task writes its files below a staging folder of the write; the
commit moves those of tasks that succeeded to their names and drops the rest, so
readers never see a torn file, and a task that ran twice leaves one copy. The driver
sees names and sizes only.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Threads of a commit, and files that one of them renames at a time.
_MOVES, _AT_ONCE = 32, 64


def filesystem(uri: str):
    """A file system and the plain path on it, of a path or an address (file, S3, GCS, HDFS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


@lru_cache(maxsize=16)
def _place(folder: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else filesystem(folder)


def _found(path: str):
    """The file system of a file and its plain path there, of a path as Spark's readers give it; a process opens the file system of a folder once."""
    folder, _, name = re.sub(r"^file:/+", "/", path).rpartition("/")
    system, base = _place(folder)
    return system, f"{base}/{name}"


def read_file(path: str) -> bytes:
    system, place = _found(path)
    with system.open_input_stream(place, compression=None) as f:
        return f.read()


def remove_file(path: str) -> None:
    """Remove a file if it is there."""
    system, place = _found(path)
    try:
        system.delete_file(place)
    except FileNotFoundError:
        pass


def remove_folder(folder: str) -> None:
    """Remove a folder of scratch files, if it is there and its store is at hand."""
    try:
        system, base = filesystem(folder)
        system.delete_dir(base)
    except (OSError, ValueError):
        pass


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class StagedFiles:
    """Files of one task of a write. Used as a context, it removes them if the task fails."""

    def __init__(self, folder: str, write_id: str) -> None:
        self.fs, base = filesystem(folder)
        self.at = f"{base}/_staging-{write_id}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.at, recursive=True)
        self.files: list[tuple[str, str]] = []

    def add(self, name: str, content: bytes) -> None:
        if not name or name.startswith(("_", ".")) or "/" in name or "\\" in name:
            raise ValueError(f"not a file name: {name!r}")
        place = f"{self.at}/{len(self.files):06d}"
        with self.fs.open_output_stream(place) as out:
            out.write(content)
        self.files.append((place, name))

    def message(self) -> _Message:
        return _Message(self.files)

    def __enter__(self) -> StagedFiles:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.fs.delete_dir(self.at)


class StagedWriter(DataSourceArrowWriter):
    """Commit and abort of staged files. Subclasses write."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite, self.id = options["path"], overwrite, uuid.uuid4().hex[:12]

    def staged(self) -> StagedFiles:
        return StagedFiles(self.folder, self.id)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, base = filesystem(self.folder)
        found = [f for m in messages if m for f in m.files]
        names = {name for _, name in found}
        # an overwrite removes what else is there, an append has to know of its own names only
        seen = system.get_file_info(fs.FileSelector(base, allow_not_found=True) if self.overwrite else [f"{base}/{n}" for n in names])
        old = {i.base_name for i in seen if i.is_file and not i.base_name.startswith(("_", "."))}
        try:
            if len(names) < len(found):
                raise ValueError("two rows have one file name")
            if not self.overwrite and old & names:
                raise FileExistsError(f"already there: {sorted(old & names)[:5]}")
            system.create_dir(base, recursive=True)
            with ThreadPoolExecutor(_MOVES) as pool:  # renames mostly wait; where they don't, one thread a name costs more than they do
                moved = lambda k: [system.move(place, f"{base}/{name}") for place, name in found[k : k + _AT_ONCE]]
                for _ in pool.map(moved, range(0, len(found), _AT_ONCE)):
                    pass
            if self.overwrite:
                for name in old - names:
                    system.delete_file(f"{base}/{name}")
        finally:
            self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.folder))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        staging = f"{base}/_staging-{self.id}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class _FileWriter(StagedWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        if {"name", "content"} - {f.name for f in schema.fields}:
            raise ValueError("files are rows of name and content")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with self.staged() as files:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if name is None or not content.is_valid:
                        raise ValueError("a file needs a name and content")
                    files.add(name, content.as_buffer())
            return files.message()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aeroframe_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _FileWriter(self.options, schema, overwrite)


def write_files(files: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write rows of (name, content) as files of ``folder``; content may be a string."""
    files.sparkSession.dataSource.register(FileSink)
    files.selectExpr("cast(name as string) as name", "cast(content as binary) as content").write.format("aeroframe_files").mode(mode).save(folder)


def zip_bytes(entries: dict[str, bytes | str]) -> bytes:
    """A zip archive whose bytes depend on its entries alone: fixed times, system and order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            info = zipfile.ZipInfo(name)
            info.create_system, info.external_attr = 3, 0o644 << 16
            z.writestr(info, data, zipfile.ZIP_DEFLATED, 6)
    return out.getvalue()
