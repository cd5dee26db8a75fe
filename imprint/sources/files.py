"""Whole files of a shared store, from and to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pafs.FileSystem.from_uri(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``content`` of (``path``, ``content``) rows to files below ``folder``, and return their number.

    A file appears whole or not at all, so a task that runs again does no harm.
    Null content is an empty file. Paths are expected to differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                place = f"{root.rstrip('/')}/{name}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{place}.tmp") as out:
                    out.write(body or b"")
                store.move(f"{place}.tmp", place)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    written = rows.select("path", "content").mapInArrow(run, "files bigint").groupBy().sum("files").first()
    return written[0] or 0
