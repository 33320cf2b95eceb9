"""Entries of zip archives as a table: a data source whose partitions are ranges of an archive's directory.

``spark.dataSource.register(ArchiveEntries)``, then ``spark.read.format("archive_entries").load(path)``. The path is any
address that Arrow's file systems open, on every machine. The directory is read once, when the read is planned; an
archive that breaks a limit, holds links or names places outside itself is refused then, before anything is inflated.
As a directory can lie, tasks count what they inflate and stop at what it states.
"""

from __future__ import annotations

import stat
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The most entries and bytes of an archive, the most bytes of one entry, and how far an entry may be packed.
MOST_ENTRIES, MOST_BYTES, MOST_ENTRY_BYTES, MOST_RATIO = 100_000, 1 << 30, 200 << 20, 1000
SCHEMA = "archive string, name string, bytes long, content binary"


class ArchiveProblem(ValueError):
    """Why an archive is not read."""


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def problem_of(entry: zipfile.ZipInfo, most_bytes: int = MOST_ENTRY_BYTES, most_ratio: int = MOST_RATIO) -> str | None:
    """link, traversal, size or ratio; the first that holds."""
    parts = entry.filename.replace("\\", "/").split("/")
    if stat.S_ISLNK(entry.external_attr >> 16):
        return "link"
    if ".." in parts or parts[0] == "" or ":" in parts[0] or "\x00" in entry.orig_filename:
        return "traversal"
    if entry.file_size > most_bytes:
        return "size"
    return "ratio" if entry.file_size > entry.compress_size * most_ratio else None


class Range(InputPartition):
    def __init__(self, first: int, after: int):
        super().__init__((first, after))
        self.first, self.after = first, after


class EntriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.each = int(options.get("entriesperpartition", "1000"))
        self.limits = {k: int(options.get(k.replace("_", ""), v)) for k, v in (("most_entries", MOST_ENTRIES), ("most_bytes", MOST_BYTES), ("most_entry_bytes", MOST_ENTRY_BYTES), ("most_ratio", MOST_RATIO))}

    def partitions(self) -> list[Range]:
        with _opened(self.path) as file, zipfile.ZipFile(file) as archive:
            entries = [e for e in archive.infolist() if not e.is_dir()]
        if len(entries) > self.limits["most_entries"]:
            raise ArchiveProblem(f"{self.path}: {len(entries)} entries")
        if sum(e.file_size for e in entries) > self.limits["most_bytes"]:
            raise ArchiveProblem(f"{self.path}: {sum(e.file_size for e in entries)} bytes")
        for e in entries:
            if found := problem_of(e, self.limits["most_entry_bytes"], self.limits["most_ratio"]):
                raise ArchiveProblem(f"{self.path}: {found}: {e.filename}")
        return [Range(k, min(k + self.each, len(entries))) for k in range(0, len(entries), self.each)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with _opened(self.path) as file, zipfile.ZipFile(file) as archive:
            for entry in [e for e in archive.infolist() if not e.is_dir()][partition.first : partition.after]:
                with archive.open(entry) as inflated:
                    content = inflated.read(entry.file_size + 1)
                if len(content) != entry.file_size:
                    raise ArchiveProblem(f"{self.path}: {entry.filename} has another size than stated")
                yield self.path, entry.filename, len(content), content


class ArchiveEntries(DataSource):
    """archive, name, bytes, content of each file in a zip archive. Options: path (as load gives it), entriesPerPartition, mostEntries,
    mostBytes, mostEntryBytes, mostRatio."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EntriesReader:
        return EntriesReader(dict(self.options))
