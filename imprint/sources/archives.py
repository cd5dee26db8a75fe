"""ZIP archives as rows."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from imprint.sources.files import open_store

_CHUNK_BYTES = 64 << 20
#: Tasks that one read is divided into, about; beyond that ranges are wider than was asked for.
_MOST_TASKS = 1000

ENTRIES = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("ordinal", pa.int64()),
        ("path", pa.string()),
        ("size", pa.int64()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files as (path, content) rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows_of(archive: str, opened: zipfile.ZipFile, with_content: bool, low: int, high: float, most: float) -> Iterator[pa.RecordBatch]:
    """Files whose headers begin in [low, high), in archive order, in batches of some 64 MB."""
    rows: list[dict] = []
    held = 0
    for ordinal, info in enumerate(opened.infolist()):
        if info.is_dir() or not low <= info.header_offset < high:
            continue
        body = error = None
        if with_content and info.file_size > most:
            error = f"{info.file_size} bytes are more than {int(most)}"
        elif with_content:
            try:
                body = opened.read(info)
            except _BROKEN as broken:
                error = str(broken)
        rows.append(
            {"archive": archive, "ordinal": ordinal, "path": info.filename, "size": info.file_size, "content": body, "error": error}
        )
        held += info.file_size if with_content else 100
        if held >= _CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def expand_archives(archives: DataFrame, with_content: bool = True) -> DataFrame:
    """One row per file of each archive, in archive order.

    ``archives`` has ``path`` and ``content``. Entries leave in batches of some
    64 MB, so only one archive and one batch are in memory. Without content only
    the directory of the archive is read. For large archives in a store use the
    ``zip_members`` source, which needs no archive in memory.

    An archive that cannot be opened is one row with its ``error`` and no path; a
    broken member keeps its row, with an ``error`` and no content. Other archives
    and members go on. A NULL content is an archive that cannot be opened.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                try:
                    opened = zipfile.ZipFile(pa.BufferReader(content.as_buffer() or b""))
                except _BROKEN as error:
                    yield pa.RecordBatch.from_pylist([{"archive": name.as_py(), "error": str(error)}], _ARROW)
                    continue
                with opened:
                    yield from _rows_of(name.as_py(), opened, with_content, 0, float("inf"), float("inf"))

    return archives.select("path", "content").mapInArrow(expand, ENTRIES)


class _Ranges(InputPartition):
    """(archive, first byte, end byte) ranges for one task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 128 << 20))
        self.most = int(options.get("memberbytes", (1 << 31) - 1))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of all archives, small archives together; only names and sizes are looked at here."""
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f for f in files if f.is_file and f.path.lower().endswith(".zip")), key=lambda f: f.path)
        # Starting a task takes as long as reading some hundred small files.
        split = max(self.split, -(-sum(f.size for f in files) // _MOST_TASKS))
        ranges: list[tuple[str, int, int]] = []
        for f in files:
            ranges += [(f.path, at, at + split) for at in range(0, max(1, f.size), split)]
            if f.size:
                path, at, _ = ranges[-1]
                ranges[-1] = (path, at, f.size)
        tasks: list[list[tuple[str, int, int]]] = []
        held = split
        for r in ranges:
            if held + r[2] - r[1] > split:
                tasks.append([])
                held = 0
            tasks[-1].append(r)
            held += r[2] - r[1]
        return [_Ranges(t) for t in tasks] or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        for path, low, high in partition.ranges:
            name = path[len(root):].lstrip("/") or path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as file:
                try:
                    opened = zipfile.ZipFile(file)
                except _BROKEN as error:
                    if low == 0:
                        yield pa.RecordBatch.from_pylist([{"archive": name, "error": str(error)}], _ARROW)
                    continue
                with opened:
                    yield from _rows_of(name, opened, self.content, low, high, self.most)


class ZipMembers(DataSource):
    """The files in the ZIP archives of a folder: ``spark.read.format("zip_members").load(folder)``.

    A task takes a range of bytes: it reads the archive's directory, at its end, and
    the files whose headers begin in the range. So one archive uses as many tasks as
    it has ranges, no archive is held in memory, and the driver opens none.

    Options: ``splitBytes`` of a range, wider where there would be far more than 1000 tasks; ``content`` (false: the directory only);
    ``memberBytes``, the largest file to be a value, beyond which its row has an
    ``error`` and no content. Rows are as those of ``expand_archives``, with the
    archive's path below the folder. Paths and URIs are those Arrow's stores open.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> T.StructType:
        return ENTRIES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ZipReader({k.lower(): v for k, v in self.options.items()})


def read_members(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Rows of the ``zip_members`` source."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(**options).load(folder)


def build_archive(entries: list[tuple[str, bytes]]) -> bytes:
    """ZIP bytes of a few entries."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as opened:
        for name, body in entries:
            opened.writestr(name, body)
    return buffer.getvalue()
