"""FASTA as a data source: ``spark.dataSource.register(FastaSource)``, then ``spark.read.format("fasta")`` and ``df.write.format("fasta")``.

Reading: ``path`` is a file or a folder, ``split`` the bytes of a partition (default 64 MB). Columns are file, header and bases; with
``dialect`` (bcalm or ggcat) and ``k`` they are unitig, length (in k-mers), links and bases. Records begin at a ">" that begins a
line, and belong to the partition that has its ">"; so any split size gives the same rows. Of several sequence lines
the last counts, and a record without one has null bases. Text before a file's first record fails.

Writing: columns header and bases, others are not written; null bases give a header alone. Modes append and overwrite. Parts are
written aside and moved when all of them are whole; what a lost task or a failed job wrote is removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes read at once, and about as many in a batch.
CHUNK = 1 << 20
#: Fields of a header before its links.
LINKS_AFTER = {"bcalm": 4, "ggcat": 2}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"^\w+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _records(stream, start: int, end: int) -> Iterator[bytes]:
    """The records whose ">" is at ``start`` or after and before ``end``, without it. A record is held whole, and no more than a chunk beyond."""
    stream.seek(max(start - 1, 0))
    held = (b"" if start else b"\n") + stream.read(CHUNK)
    at, ended = start - 1, False  # the place in the file of held[0]
    first, seek_from = True, 0
    while True:
        mark = held.find(b"\n>", seek_from)
        if mark < 0 and not ended:
            if first and start and len(held) > 1:  # nothing before the first record is ours
                at, held = at + len(held) - 1, held[-1:]
            more = stream.read(CHUNK)
            ended, seek_from = not more, max(len(held) - 1, 0)
            held += more
            continue
        if first and not start and held[: mark if mark >= 0 else None].strip():
            raise ValueError("text before the first record")
        if not first:
            yield held[: mark if mark >= 0 else None]
        if mark < 0 or at + mark + 1 >= end:
            return
        at, held, first, seek_from = at + mark + 2, held[mark + 2 :], False, 0


def _split(record: bytes) -> tuple[str, str | None]:
    lines = [x for x in record.decode().replace("\r", "").split("\n") if x.strip(" ")]
    return (lines[0] if lines else ""), (lines[-1] if len(lines) > 1 else None)


class FastaReader(DataSourceReader):
    def __init__(self, path: str, size: int, dialect: str | None, k: int) -> None:
        self.path, self.size, self.dialect, self.k = path, size, dialect, k

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        below = lambda f: f.path[len(path) :].split("/")
        files = [f for f in files if f.type == fs.FileType.File and f.size and not any(p.startswith(("_", ".")) for p in below(f))]
        prefix = self.path[: len(self.path.rstrip("/")) - len(path.rstrip("/"))]
        return [Range(prefix + f.path, at, min(at + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def _row(self, file: str, header: str, bases: str | None) -> tuple:
        if self.dialect is None:
            return file, header, bases
        fields = header.split()
        return fields[0], int(fields[1].split(":")[-1]) - (self.k - 1), fields[LINKS_AFTER[self.dialect] :], bases

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        names, kinds = (("file", "header", "bases"), (pa.string(),) * 3) if self.dialect is None else (("unitig", "length", "links", "bases"), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()))
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))
        system, path = _open(partition.file)
        rows, size = [], 0
        with system.open_input_file(path) as stream:
            for record in _records(stream, partition.start, partition.end):
                rows.append(self._row(partition.file, *_split(record)))
                size += len(record)
                if size >= CHUNK:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Part(WriterCommitMessage):
    file: str


class FastaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        if missing := {"header", "bases"} - set(schema.names):
            raise ValueError(f"no such columns: {sorted(missing)}")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.at = [schema.names.index(c) for c in ("header", "bases")]

    @property
    def aside(self) -> str:
        return f"{_open(self.path)[1]}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One task's rows into a file of its own aside; another attempt at the same rows has another file."""
        system, _ = _open(self.path)
        system.create_dir(self.aside)
        name = f"part-{uuid.uuid4().hex}.fasta"
        with system.open_output_stream(f"{self.aside}/{name}") as out:
            for batch in iterator:
                for header, bases in zip(*(batch.column(i).to_pylist() for i in self.at)):
                    if header is None or "\n" in header or "\n" in (bases or ""):
                        raise ValueError(f"not a header and a line of bases: {header!r}")
                    out.write(f">{header}\n{'' if bases is None else bases + chr(10)}".encode())
        return Part(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move the parts that count; files of attempts that do not count go with the folder aside."""
        system, path = _open(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.path.rstrip("/") != self.aside:
                    (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{self.aside}/{m.file}", f"{path}/{m.file}")
        self._clear()
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _ = _open(self.path)
        if system.get_file_info(self.aside).type != fs.FileType.NotFound:
            system.delete_dir(self.aside)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "unitig string, length bigint, links array<string>, bases string" if self._dialect() else "file string, header string, bases string"

    def _dialect(self) -> str | None:
        dialect = self.options.get("dialect")
        if dialect is not None and dialect not in LINKS_AFTER:
            raise ValueError(f"dialect must be one of {sorted(LINKS_AFTER)}: {dialect}")
        if dialect is not None and "k" not in self.options:
            raise ValueError("a dialect needs k")
        return dialect

    def reader(self, schema: StructType) -> DataSourceReader:
        size = int(self.options.get("split", 64 << 20))
        if size < 1:
            raise ValueError(f"split must be 1 or more: {size}")
        return FastaReader(self.options["path"], size, self._dialect(), int(self.options.get("k", 1)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FastaWriter(self.options["path"], schema, overwrite)
