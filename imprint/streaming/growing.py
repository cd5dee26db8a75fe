"""Tables that grow by one part per micro-batch and are read by bucket.

A part is a folder of Parquet, divided by ``bucket``, that holds the rows of one or
more consecutive micro-batches. It counts once it is wholly written. A micro-batch
that is run again replaces its own part and reads only earlier ones, so a retry
changes nothing. Where enough parts of about the same size lie at the end they are
written as one, so a table of n micro-batches has about log n parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame) -> list[int]:
    """Buckets that rows have; at most as many as there are buckets."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


@dataclass(frozen=True)
class GrowingTable:
    """One table below ``folder``; ``fan`` parts of a size become one of the next size."""

    folder: str
    fan: int = 8

    def _path(self, spark: SparkSession, *names: str):
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    @staticmethod
    def _name(first: int, last: int) -> str:
        return f"part={first:012d}_{last:012d}"

    def parts(self, spark: SparkSession, before: int | None = None) -> list[tuple[int, int]]:
        """(first, last) micro-batch of the widest whole parts, in order, that end before a micro-batch."""
        files, path = self._path(spark)
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("part=") and files.exists(self._path(spark, name, "_SUCCESS")[1]):
                first, last = map(int, name[5:].split("_"))
                if before is None or last < before:
                    found.append((first, last))
        kept: list[tuple[int, int]] = []
        for first, last in sorted(found, key=lambda p: (p[0], -p[1])):
            if not kept or first > kept[-1][1]:
                kept.append((first, last))
        return kept

    def _read(self, spark: SparkSession, schema: StructType, parts: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.folder}/{self._name(*p)}" for p in parts]
        columns = [c for c in schema.names if c != "bucket"]
        plain = StructType([f for f in schema.fields if f.name != "bucket"]).add("part", StringType()).add("bucket", IntegerType())
        if not paths:
            return spark.createDataFrame([], plain).select(*columns, "bucket")
        return spark.read.schema(plain).option("basePath", self.folder).parquet(*paths).select(*columns, "bucket")

    def read(self, spark: SparkSession, schema: StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all micro-batches before one, of the given buckets; other buckets are not opened."""
        rows = self._read(spark, schema, self.parts(spark, before))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def write(self, rows: DataFrame, epoch: int, gather: bool = True) -> DataFrame:
        """Write the part of one micro-batch and return what is in it.

        Without ``gather`` rows are written where they are made, which suits many rows of few buckets.
        """
        self._save(rows.hint("rebalance", "bucket") if gather else rows, epoch, epoch)
        return self._read(rows.sparkSession, rows.schema, [(epoch, epoch)])

    def _save(self, rows: DataFrame, first: int, last: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{self._name(first, last)}")

    def compact(self, spark: SparkSession, schema: StructType, before: int) -> None:
        """Join parts of one size at the end of what lies before a micro-batch, then drop what is covered by wider parts.

        The running micro-batch is never touched, so it can still be run again.
        """
        while True:
            parts = self.parts(spark, before)
            sizes = [len(_digits(last - first + 1, self.fan)) for first, last in parts]
            run = next((k for k, s in enumerate(reversed(sizes)) if s != sizes[-1]), len(sizes))
            if run < self.fan:
                break
            taken = parts[-run:]
            self._save(self._read(spark, schema, taken).hint("rebalance", "bucket"), taken[0][0], taken[-1][1])
        self._drop_covered(spark, before)

    def _drop_covered(self, spark: SparkSession, before: int) -> None:
        live = set(self.parts(spark, before))
        files, path = self._path(spark)
        if not files.exists(path):
            return
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("part="):
                first, last = map(int, name[5:].split("_"))
                if last < before and (first, last) not in live and any(a <= first and last <= b for a, b in live):
                    files.delete(status.getPath(), True)


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, digit = divmod(n, base)
        out.append(digit)
    return out
