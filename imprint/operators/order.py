"""Neighbours in a total order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.session import materialize


def with_previous(rows: DataFrame, group: str, order: list[str], id_col: str, name: str = "previous", tasks: int | None = None) -> DataFrame:
    """Add the id of the row before, by ``order`` and then id, within ``group``; NULL for the first.

    The rows are sorted by ranges, which cut a large group between tasks. A task sees
    the row before for all of its rows but the first; that one's is the last row of
    the range before, taken from a table of one row a range. Rows that repeat an id
    follow each other. A NULL group is a group.
    """
    spark = rows.sparkSession
    keys = [group, *order, id_col]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = {f.name: f.dataType for f in rows.schema.fields}
    added = [
        T.StructField(name, fields[id_col]), T.StructField("_range", T.IntegerType()), T.StructField("_opens", T.BooleanType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, ids = batch.column(group).to_pylist(), batch.column(id_col).to_pylist()
            opens = [False] * len(ids)
            opens[0] = last is None
            before = [last or (None, None), *zip(groups, ids)]
            previous = [i if g == own and not first else None for (g, i), own, first in zip(before, groups, opens)]
            last = (groups[-1], ids[-1])
            for values, kind in ((previous, batch.schema.field(id_col).type), (opens, pa.bool_())):
                batch = batch.append_column(name if kind is not pa.bool_() else "_opens", pa.array(values, kind))
            yield batch

    ranged = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, added[1], added[0], added[2]])
    sorted_ = materialize(ranged.mapInArrow(run, schema))
    ends = sorted_.groupBy("_range").agg(F.max(F.struct(*keys)).alias("end"))
    # One row a range.
    along = Window.orderBy("_range")
    handed = ends.select(
        "_range", F.lag(F.col("end")[group]).over(along).alias("_group"), F.lag(F.col("end")[id_col]).over(along).alias("_id")
    )
    joined = sorted_.join(F.broadcast(handed), "_range", "left")
    first = F.col("_opens") & F.col(group).eqNullSafe(F.col("_group"))
    return joined.withColumn(name, F.when(first, F.col("_id")).otherwise(F.col(name))).select(*rows.columns, name)
