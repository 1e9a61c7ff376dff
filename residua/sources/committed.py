"""Results that are there whole or not at all: single documents, and tables in versions.

A document is one file. The task that writes it writes beside it, and the commit moves the file into
place, so whoever reads it finds the old or the new one. A table is a folder of versions and a pointer
that names the files of one of them. A version is written completely before the pointer moves, which
is the last thing that happens; a writer that dies before that leaves the old version in force.
All paths go through one file system, that of the path given.
"""

from __future__ import annotations

import csv
import io
import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..contracts import ArtifactError

POINTER = "CURRENT"
FORMATS = ("json", "csv", "text")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local or mounted one."""
    return fs.FileSystem.from_uri(path)


def write_file(path: str, content: bytes) -> None:
    """Replace a whole file by a move, the only step that readers can see."""
    store, own = located(path)
    folder, _, name = own.rpartition("/")
    store.create_dir(folder, recursive=True)
    partial = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as out:
        out.write(content)
    store.move(partial, own)


def write_text(path: str, text: str) -> None:
    write_file(path, text.encode())


def read_file(path: str) -> bytes | None:
    """The content of a file, None where there is none."""
    store, own = located(path)
    if store.get_file_info(own).type != fs.FileType.File:
        return None
    with store.open_input_stream(own) as held:
        return held.read()


def _plain(value: object) -> object:
    """A value as JSON holds it."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def _cell(value: object) -> object:
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat() if isinstance(value, date) else value


@dataclass
class Written(WriterCommitMessage):
    partial: str | None
    rows: int


class DocumentWriter(DataSourceWriter):
    """Writes one file: `write` beside its place, `commit` moves it there, `abort` takes the parts away."""

    def __init__(self, path: str, kind: str, names: Sequence[str]) -> None:
        if kind not in FORMATS:
            raise ArtifactError(f"a document is one of {FORMATS}, not {kind!r}")
        self.path, self.kind, self.names = path, kind, list(names)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, own = located(self.path)
        folder, _, name = own.rpartition("/")
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        store.create_dir(folder, recursive=True)
        partial, rows = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(partial) as out:
            out.write(self.head())
            row = first
            while row is not None:
                out.write(self.line(row))
                rows, row = rows + 1, next(iterator, None)
        return Written(partial, rows)

    def head(self) -> bytes:
        return self.joined(self.names) if self.kind == "csv" else b""

    @staticmethod
    def joined(values: Sequence[object]) -> bytes:
        held = io.StringIO()
        csv.writer(held, lineterminator="\n").writerow(values)
        return held.getvalue().encode()

    def line(self, row: Row) -> bytes:
        if self.kind == "csv":
            return self.joined([_cell(v) for v in row])
        if self.kind == "json":
            return (json.dumps({k: _plain(v) for k, v in zip(self.names, row, strict=True)}, sort_keys=True) + "\n").encode()
        return f"{row[0]}\n".encode()

    def commit(self, messages: list[Written | None]) -> None:
        parts = [m for m in messages if m and m.partial]
        if len(parts) > 1:
            self.abort(messages)
            raise ArtifactError("a document is written by one task: coalesce it to one partition")
        if not parts:
            write_file(self.path, self.head())
            return
        store, own = located(self.path)
        store.move(parts[0].partial, own)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = located(self.path)
        for m in messages:
            if m and m.partial and store.get_file_info(m.partial).type == fs.FileType.File:
                store.delete_file(m.partial)


class DocumentSource(DataSource):
    """`document`: a write-only source. Options: path, kind (json, csv or text)."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> T.StructType:
        raise ArtifactError("documents are read as the json, csv or text that they are")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"], self.options.get("kind", "json"), schema.names)


class FilesWriter(DataSourceWriter):
    """Writes a file per row (name, content) below a folder; all of them appear at the commit, or none."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = path, overwrite, f"{path}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, own = located(self.staging)
        folder, names = f"{own}/{uuid.uuid4().hex}", []
        for name, content in iterator:
            if not name or name.startswith((".", "/")) or ".." in name.split("/"):
                raise ArtifactError(f"{name!r} is no name of a file below {self.path}")
            target = f"{folder}/{name}"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            with store.open_output_stream(target) as out:
                out.write(content or b"")
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, own = located(self.path)
        staged = [(m.folder, name) for m in messages if m for name in m.names]
        names = [name for _, name in staged]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        there = [] if self.overwrite else [x.path for x in store.get_file_info([f"{own}/{n}" for n in names]) if x.type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ArtifactError(f"files are written twice: {twice or there}"[:300])
        store.create_dir(own, recursive=True)
        for folder, name in staged:
            if "/" in name:
                store.create_dir(f"{own}/{name}".rpartition("/")[0], recursive=True)
            store.move(f"{folder}/{name}", f"{own}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, staging = located(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FilesSource(DataSource):
    """`files`: a write-only source of rows (name string, content binary). Option: path."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> T.StructType:
        raise ArtifactError("files are read as what they are")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema] != ["string", "binary"]:
            raise ArtifactError(f"files need (name string, content binary), not {schema.simpleString()}")
        return FilesWriter(self.options["path"], overwrite)


def save_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file per row (name, content) below path, written by the tasks and moved into place at the commit.

    A name that comes twice, or is there already unless overwritten, is an error and nothing appears.
    """
    rows.sparkSession.dataSource.register(FilesSource)
    rows.write.format("files").mode("overwrite" if overwrite else "append").save(path)


def save_document(rows: DataFrame, path: str, kind: str = "json") -> None:
    """The rows of a report, few by nature, as one file that replaces an older one whole.

    JSON is a line per row with sorted keys, nulls kept and NaN null; CSV has a header and empty cells for nulls; text is the first column. No
    rows give an empty document, a CSV its header.
    """
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.coalesce(1).write.format("document").mode("append").option("kind", kind).save(path)


def save_version(rows: DataFrame, path: str, key: Mapping[str, str] | None = None) -> str:
    """Write the rows as a new version of the table at path, then make it the current one; its name.

    `key` is kept with it: what the rows were made from. Spark's own committer puts the version's files
    in place, tasks that were lost or doubled included.
    """
    version = uuid.uuid4().hex
    rows.write.parquet(f"{path}/versions/{version}")
    publish(path, version, key)
    return version


def publish(path: str, version: str, key: Mapping[str, str] | None = None) -> None:
    """Move the pointer to a version that is written whole."""
    store, own = located(f"{path}/versions/{version}")
    found = [x for x in store.get_file_info(fs.FileSelector(own, recursive=True)) if x.is_file]
    if not any(x.base_name == "_SUCCESS" for x in found):
        raise ArtifactError(f"version {version} is not written whole")
    files = sorted(x.path[len(own) + 1 :] for x in found if x.base_name.startswith("part-"))
    write_text(f"{path}/{POINTER}", json.dumps({"version": version, "files": files, "key": dict(key or {}), "written": time.time()}, indent=2, sort_keys=True) + "\n")


def current(path: str) -> dict | None:
    """What the pointer says: version, files, key, written. None where no version was ever committed."""
    content = read_file(f"{path}/{POINTER}")
    if content is None:
        return None
    try:
        found = json.loads(content)
        return {name: found[name] for name in ("version", "files", "key", "written")}
    except (ValueError, KeyError, TypeError) as error:
        raise ArtifactError(f"malformed pointer at {path}: {error!r}") from error


def load_version(spark: SparkSession, path: str, key: Mapping[str, str] | None = None) -> DataFrame | None:
    """The current version's rows; None where there is none. A field of `key` that differs is an error that names it."""
    found = current(path)
    if found is None:
        return None
    for name in sorted(found["key"].keys() | key.keys()) if key is not None else ():
        if found["key"].get(name) != key.get(name):
            raise ArtifactError(f"{path} differs in {name}: {found['key'].get(name)!r}, wanted {key.get(name)!r}")
    base = f"{path}/versions/{found['version']}"
    return spark.read.option("basePath", base).parquet(*(f"{base}/{name}" for name in found["files"])) if found["files"] else spark.read.parquet(base)


def drop_old_versions(path: str, keep: int = 1, older_than: float = 3600.0) -> list[str]:
    """Remove versions that are not current, except the newest `keep` and those younger than `older_than` seconds, which a writer or reader may still hold; their names."""
    found, (store, own) = current(path), located(f"{path}/versions")
    if found is None:
        return []
    held = [x for x in store.get_file_info(fs.FileSelector(own)) if x.type == fs.FileType.Directory and x.base_name != found["version"]]
    ages = sorted(((x.mtime.timestamp() if x.mtime else 0.0, x.base_name) for x in held), reverse=True)
    gone = [name for at, name in ages[keep:] if at <= time.time() - older_than]
    for name in gone:
        store.delete_dir(f"{own}/{name}")
    return gone
