"""A sink that writes each document to one file under its own name, in batches and streams.

Spark's own text writer names files by task and needs a folder a document. Here a task streams the lines of a document
to a hidden file and renames it when the document is whole, so a task that is lost, repeated or run twice leaves no half
document and no second copy. The driver gets two numbers from each task and writes `_SUCCESS` with their sums. Files are written by pyarrow's file
systems: a folder that is mounted on all executors, or an object store that they know.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "docloom_files"
#: Longer names end in a digest, since file systems take no more than 255 bytes.
LONGEST_NAME = 180
#: The file name of the document whose name is null; no other document has it.
NULL_NAME = "%00null"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it; one without a scheme, or with `file:`, is in a mounted folder."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_name(name: str | None, suffix: str = "") -> str:
    """The file of a document: its name with all but letters, digits and `_.-~` of ASCII percent-encoded, and the suffix.

    A leading dot or underscore is encoded too, since readers pass over such files.
    """
    if name is None:
        return NULL_NAME + suffix
    safe = quote(name, safe="")
    if safe[:1] in (".", "_"):
        safe = f"%{ord(safe[0]):02X}{safe[1:]}"
    if len(safe) > LONGEST_NAME or not safe:
        safe = f"{safe[: LONGEST_NAME - 65]}-{hashlib.sha256(name.encode()).hexdigest()}"
    return safe + suffix


@dataclass
class Written(WriterCommitMessage):
    documents: int
    lines: int


class _Files:
    """The part of a task: batches of (name, line), those of a document one after the other, names in ascending order."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError(f"{FORMAT} needs a path")
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        out, current, documents, lines = None, None, 0, 0
        try:
            for batch in batches:
                names, texts = batch.column(0), batch.column(1)
                codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.diff(codes, prepend=-2))
                for a, b in zip(starts.tolist(), np.append(starts, len(codes))[1:].tolist(), strict=True):
                    name = names[a].as_py()
                    if out is None or name != current:
                        if out is not None:
                            if current is None or (name is not None and name < current):
                                raise ValueError(f"{FORMAT}: {name!r} comes after {current!r}; lines must be sorted by name within a task")
                            self._finish(store, out, hidden, f"{folder}/{file_name(current, self.suffix)}")
                        out, current, documents = store.open_output_stream(hidden), name, documents + 1
                    out.write("".join(f"{x}\n" for x in texts[a:b].to_pylist() if x is not None).encode())
                    lines += b - a
            if out is not None:
                self._finish(store, out, hidden, f"{folder}/{file_name(current, self.suffix)}")
                out = None
        finally:
            if out is not None:
                out.close()
                store.delete_file(hidden)
        return Written(documents, lines)

    @staticmethod
    def _finish(store: fs.FileSystem, out, hidden: str, final: str) -> None:
        out.close()
        store.move(hidden, final)

    def _mark(self, messages: list[Written | None], name: str) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(json.dumps({"documents": sum(m.documents for m in done), "lines": sum(m.lines for m in done)}).encode())


class FilesWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._mark(messages, "_SUCCESS")

    def abort(self, messages: list[Written | None]) -> None:
        """Documents that are whole stay; without `_SUCCESS` nobody takes them for all of them."""


class StreamFilesWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._mark(messages, f"_SUCCESS-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass


class DocumentFiles(DataSource):
    """`docloom_files`: takes (name, line), appends; documents whose names are there already are replaced.

    Options: path, and suffix, which ends each file's name. Lines that are null are left out.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, line string"

    def _checked(self, schema, overwrite: bool) -> None:
        if [(f.name, f.dataType.simpleString()) for f in schema.fields] != [("name", "string"), ("line", "string")]:
            raise ValueError(f"{FORMAT} takes (name string, line string), not {schema.simpleString()}")
        if overwrite:
            raise ValueError(f"{FORMAT} only appends; documents of the same name are replaced")

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        self._checked(schema, overwrite)
        return FilesWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamFilesWriter:
        self._checked(schema, overwrite)
        return StreamFilesWriter(self.options)


def write_files(lines: DataFrame, path: str, by: str = "doc", n: str | None = "n", line: str = "line", suffix: str = "") -> None:
    """Writes the lines of each document, in the order of `n`, to one file named by the document.

    A task streams its documents one after the other and holds a batch of lines at a time. Lines without an order
    (`n` None) are for documents of one row.
    """
    lines.sparkSession.dataSource.register(DocumentFiles)
    order = ["name"] if n is None else ["name", n]
    rows = lines.select(F.col(by).cast("string").alias("name"), *order[1:], F.col(line).alias("line"))
    placed = rows.repartition("name").sortWithinPartitions(*[F.col(x).asc_nulls_last() for x in order])
    placed.select("name", "line").write.format(FORMAT).mode("append").option("suffix", suffix).save(path)


def document_of(path: Column | str, suffix: str = "") -> Column:
    """The document's name from its file's `_metadata.file_path`, which Spark gives percent-encoded once more.

    Names that are empty or longer than `LONGEST_NAME` when encoded can't be told from their files; the null name is null.
    """
    name = F.url_decode(F.substring_index(path, "/", -1))
    name = F.substring(name, F.lit(1), F.length(name) - len(suffix)) if suffix else name
    return F.when(name != NULL_NAME, F.url_decode(name))
