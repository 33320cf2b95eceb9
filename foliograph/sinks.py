"""Sinks that a lost task can't spoil: ledgers that are appended to, and pages as files.

A ledger is a folder of Parquet files and of manifests that name them. A task writes a
file of its own; only when all tasks have ended does the batch's manifest name their
files. Files of attempts that failed, or came in twice, are named by none, so they are not
there for readers; a batch that is written again replaces its manifest, so it counts once.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from foliograph.workspace import bounded_batches

_BATCH = re.compile(r"[A-Za-z0-9._-]+")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """Whole or not at all: written beside, then moved into place."""
    system, inner = _system(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    beside = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, inner)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.batch = options["path"].rstrip("/"), options["batch"]
        if not _BATCH.fullmatch(self.batch):
            raise ValueError(f"batch: {self.batch}")

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq

        system, inner = _system(self.path)
        name, out, rows = f"part-{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if out is None:
                system.create_dir(f"{inner}/data", recursive=True)
                out = pq.ParquetWriter(f"{inner}/data/{name}", batch.schema, filesystem=system)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None and m.file]
        _put(f"{self.path}/manifests/{self.batch}.json", json.dumps({"files": sorted(m.file for m in done), "rows": sum(m.rows for m in done)}).encode())


class LedgerSink(DataSource):
    """Options: path, and batch, which names what is written: the same batch again takes the place of the first."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is appended to")
        return LedgerWriter(dict(self.options))


def append(rows: DataFrame, path: str, batch: str) -> None:
    rows.sparkSession.dataSource.register(LedgerSink)
    rows.write.format("ledger").mode("append").option("batch", batch).save(path)


def manifests(path: str) -> dict[str, dict]:
    """files and rows of each batch."""
    from pyarrow import fs

    system, inner = _system(path.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(f"{inner}/manifests", allow_not_found=True))
    out = {}
    for f in found:
        if f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as data:
                out[f.base_name.removesuffix(".json")] = json.loads(data.read())
    return out


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches."""
    files = [f"{path.rstrip('/')}/data/{f}" for m in manifests(path).values() for f in m["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def write_pages(pages: DataFrame, folder: str, suffix: str = ".mdx") -> DataFrame:
    """Writes pages (route, text), a file each, where their routes say, and returns route, file, bytes, sha256 of what has been written.

    A file is moved into place whole, so an attempt that fails leaves none behind half written, and one that comes again writes
    the same. Routes that are null, empty or climb out of the folder raise; routes are unique."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for route, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = (route or "").strip("/").split("/")
                if any(p in ("", ".", "..") or "\\" in p or "\x00" in p for p in parts):
                    raise ValueError(f"no file for route {route!r}")
                data, file = (text or "").encode(), f"{folder.rstrip('/')}/{'/'.join(parts)}{suffix}"
                _put(file, data)
                rows.append((route, file, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["route", "file", "bytes", "sha256"])

    return bounded_batches(pages.select("route", "text")).mapInArrow(run, "route string, file string, bytes long, sha256 string")
