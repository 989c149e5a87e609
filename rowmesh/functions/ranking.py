"""Ranks and running sums that no single task has to make."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .storage import written

#: Input bytes that one range of ranked() should stand for, and how many ranges one shuffle has at most; beyond that they grow, and their sorts spill.
RANGE_BYTES, MOST_RANGES = 512 << 20, 1 << 15
#: What Spark says of the size of a table that it knows nothing about, or more.
_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < _UNKNOWN)


def ranges_for(df: DataFrame) -> int:
    """How many range partitions suit df: by the bytes of the tables it reads, and no fewer than a shuffle has."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, math.ceil(input_bytes(df) / RANGE_BYTES)))


def same_as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; null equals null, NaN equals NaN."""
    odd = column.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
    if pa.types.is_floating(column.type):
        odd[pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)] = 2
    equal = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return equal | (odd[1:] > 0) & (odd[1:] == odd[:-1])


def _numbered(group: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of their group, with three columns more: each row's place in the partition, the rows of its group before it there, and whether its group is the partition's first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, begun, first = None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for k in group:
                column = batch.column(k)
                starts[1:] |= ~same_as_before(column)
                starts[0] |= last is not None and not same_as_before(pa.concat_arrays([last.column(k), column[:1]]))[0]
            places = np.arange(at, at + n)
            # Where each row's group begins: at its last start, or where the group before this batch did.
            begins = np.maximum.accumulate(np.where(starts, places, begun))
            firsts = (np.cumsum(starts) == 0) & first
            first, begun, at, last = bool(firsts[-1]), int(begins[-1]), at + n, batch.slice(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(places - begins), pa.array(firsts)], [*batch.schema.names, "_at", "_run", "_first"])

    return each


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with a column more: whether a row is the first or the last of all."""
    held, first = None, True

    def marked(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        edge = np.zeros(batch.num_rows, bool)
        edge[0], edge[-1] = edge[0] | first, edge[-1] | last
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], [*batch.schema.names, "_edge"])

    for batch in batches:
        if held is not None:
            yield marked(held, False)
            first = False
        held = batch
    if held is not None:
        yield marked(held, True)


def in_ranges(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned by the keys and in their order within partitions, as many as ranges_for() says."""
    # A tie-breaker among the range keys splits rows that are equal in all else.
    tied, keys = df.withColumn("_tie", F.monotonically_increasing_id()), [*keys, "_tie"]
    return tied.repartitionByRange(partitions or ranges_for(df), *keys).sortWithinPartitions(*keys).drop("_tie")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with the rank (0-based, long) of each row in its group under `order`; rows equal in all of it stand in any order.

    Rows are range-partitioned by group and order and sorted within partitions, so
    a group of any size is spread over tasks, and numbered where they lie. A carry table
    of one row per partition holds how many rows the group at a partition's start has in
    the partitions before; it is all that is joined back. Null is a group like any other.
    """
    rows = in_ranges(df, [*group, *order], partitions).withColumn("_part", F.spark_partition_id())
    schema = StructType([*rows.schema, StructField("_at", LongType()), StructField("_run", LongType()), StructField("_first", BooleanType()), StructField("_edge", BooleanType())])
    number = _numbered([df.columns.index(g) for g in group])
    rows = written(rows.mapInArrow(lambda batches: _edges(number(batches)), schema), "ranked")
    # Parquet's statistics let the scan pass over all but the first and last pages of each partition.
    carries = written(carries_of(rows.where("_edge"), group), "carries")
    rank = F.col("_run") + F.when(F.col("_first"), F.col("_carry")).otherwise(F.lit(0))
    return rows.join(F.broadcast(carries), "_part").select(*df.columns, rank.alias(name))


def carries_of(rows: DataFrame, group: list[str]) -> DataFrame:
    """(_part, _carry): for each partition, how many rows of its first group lie in the partitions before it; from their first and last rows.

    Of each row: its partition, its place there (_at), the rows of its group before it there (_run), and whether its group is the partition's first (_first).
    """
    key = F.struct(F.lit(0).alias("one"), *group)
    parts = rows.groupBy("_part").agg(
        F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"), (F.max_by("_run", "_at") + 1).alias("n"), F.max_by("_first", "_at").alias("single")
    )
    by_part = Window.orderBy("_part")
    goes_on = F.lag("tail").over(by_part).eqNullSafe(F.col("head"))
    # A group goes through a partition if it came in and is all there is; its rows add up from the last partition where it didn't.
    parts = parts.withColumn("goes_on", goes_on).withColumn("stretch", F.sum((~(F.col("goes_on") & F.col("single"))).cast("int")).over(by_part))
    parts = parts.withColumn("out", F.sum("n").over(Window.partitionBy("stretch").orderBy("_part")))
    return parts.select("_part", F.when(F.col("goes_on"), F.lag("out").over(by_part)).otherwise(F.lit(0)).alias("_carry"))


def exclusive_sum(df: DataFrame, group: str, order: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` over the rows of its group with a lesser `order` (a dense whole number, unique in the group).

    Two phases: sums of blocks of `block` numbers are added up first, a table that
    is smaller by that factor, then each block is summed from its start.
    """
    blocked = df.withColumn("_block", F.expr(f"`{order}` div {int(block)}"))
    sums = blocked.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_block", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(sums, [group, "_block"]).withColumn(name, F.col(name) + F.col("_start")).select(*df.columns, name)
