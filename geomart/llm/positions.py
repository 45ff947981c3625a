"""Places of rows within their group in a total order, without a task or a
window that holds a whole group.

Rows are range-partitioned and sorted by (group, order), so a group lies in
consecutive partitions and one that holds a third of all rows is spread over a
third of them. Each partition numbers its rows from the start of their group or
of the partition; what a group counts in the partitions before is one number
per partition, added up on the driver (as many rows as there are partitions).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.llm.common import materialise

#: Rows of a range partition, on average at most.
PARTITION_ROWS = 400_000


def sorted_ranges(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """A stored table ``df``, range-partitioned by ``keys`` and sorted."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-df.count() // PARTITION_ROWS))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def _same_as_before(batch: pa.RecordBatch, group: Sequence[str], last: list | None) -> np.ndarray:
    """Whether each row is of the group of the row before it."""
    same = np.ones(batch.num_rows, bool)
    same[0] = last is not None and last == [batch.column(c)[0].as_py() for c in group]
    for c in group:
        now, before = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        equal = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return same


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, out: str = "pos") -> DataFrame:
    """``df`` with the place ``out`` (from 0) of each row in its ``group``.

    Nulls form a group of their own. Rows that tie in ``order`` keep the order
    in which the stored table has them; rows that are equal in all columns are
    interchangeable, so results agree between runs if ``order`` tells the others
    apart. No ``group``: places in the whole table. The result is a stored table.
    """
    spark = df.sparkSession
    stored = materialise(df.withColumn("__row", F.monotonically_increasing_id()), f"{name}_rows")
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order, F.col("__row")]
    # Plain names while Python has the rows: a column's own may hold a dot.
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(stored.schema.fields)]
    grouped = [f"c{stored.columns.index(c)}" for c in group]
    new = [T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField(out, T.LongType())]
    schema = T.StructType([*plain, *new])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, run, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            index = np.arange(at, at + n)
            starts = np.where(_same_as_before(batch, grouped, last), run, index)
            starts = np.maximum.accumulate(starts)
            run, at, last = int(starts[-1]), at + n, [batch.column(c)[n - 1].as_py() for c in grouped]
            added = [pa.array(np.full(n, part), pa.int32()), pa.array(index), pa.array(index - starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.fieldNames())

    numbered = sorted_ranges(stored, keys).toDF(*[f.name for f in plain]).mapInArrow(number, schema)
    placed = materialise(numbered.toDF(*stored.columns, *[f.name for f in new]), f"{name}_places")
    of = F.struct(*[F.col(c) for c in group], F.lit(0).alias("__none"))
    ends = placed.groupBy("__part").agg(
        F.min_by(of, "__at").alias("first"), F.max_by(of, "__at").alias("last"), F.max_by(out, "__at").alias("place"), F.max("__at").alias("at")
    )
    before, carried = {}, (None, 0)
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        if r["first"] == carried[0]:
            before[r["__part"]] = carried[1]
        whole = r["place"] == r["at"]
        carried = (r["last"], r["place"] + 1 + (before.get(r["__part"], 0) if whole else 0))
    if before:
        # One row per partition at most.
        offsets = spark.createDataFrame(list(before.items()), "__part int, __before long")
        placed = placed.join(F.broadcast(offsets), "__part", "left")
        placed = placed.withColumn(out, F.col(out) + F.when(F.col(out) == F.col("__at"), F.coalesce("__before", F.lit(0))).otherwise(0)).drop("__before")
    return placed.drop("__part", "__at", "__row")
