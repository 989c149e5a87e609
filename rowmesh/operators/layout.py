"""Layouts of sparse matrices: symmetric expansion, order, counts, row pointers, slots, packed rows.

entries(matrix, i, j, v) holds one row per stored entry, 0-based. Entries that
repeat a place and explicit zeros are kept. rows(matrix, i) is the domain of rows,
0 to nrows - 1, so that empty rows are seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmesh.functions.ranking import carries_of, exclusive_sum, in_ranges, ranked, same_as_before
from rowmesh.functions.storage import written

#: Entries of a row that one packed segment holds at most.
SEGMENT = 4096


def sym_expand(entries: DataFrame, symmetry: Column) -> DataFrame:
    """entries with the mirror of each off-diagonal entry of a symmetric or skew-symmetric matrix; the latter's has the other sign.

    Entries of any other symmetry, or of none, and those with a null row or column stay
    as they are; repeated ones are each mirrored. No entries give none.
    """
    own, mirror = F.struct("i", "j", "v"), lambda v: F.struct(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v"))
    off = F.col("i") != F.col("j")
    cells = (
        F.when((symmetry == "symmetric") & off, F.array(own, mirror(F.col("v"))))
        .when((symmetry == "skew-symmetric") & off, F.array(own, mirror(-F.col("v"))))
        .otherwise(F.array(own))
    )
    rest = [c for c in entries.columns if c not in ("i", "j", "v")]
    return entries.select(*rest, F.inline(cells))


def row_domain(matrices: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(matrix, i) for every row of matrices(matrix, nrows), made in blocks so that one large matrix is spread over tasks."""
    starts = matrices.where("nrows > 0").select("matrix", "nrows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nrows") - 1, F.lit(block).cast("long"))).alias("s"))
    # A number of partitions, as Spark would put these few rows together into one.
    n = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n, "matrix", "s").select("matrix", F.explode(F.sequence("s", F.least(F.col("s") + block, F.col("nrows")) - 1)).alias("i"))


def coo_sort(entries: DataFrame) -> DataFrame:
    """entries in order of matrix, row, column and value."""
    return entries.orderBy("matrix", "i", "j", "v")


def row_counts(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(matrix, i, n): entries of each row, repeated places included, 0 for an empty row."""
    found = entries.groupBy("matrix", "i").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(found, ["matrix", "i"], "left").select("matrix", "i", F.coalesce("n", F.lit(0)).alias("n"))


def row_ptr(entries: DataFrame, rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(matrix, i, n, ptr): count of each row, and of all entries in the rows before it."""
    return exclusive_sum(row_counts(entries, rows), "matrix", "i", "n", "ptr", block)


def csr_slots(entries: DataFrame) -> DataFrame:
    """(matrix, i, j, v, pos): the place of each entry in its matrix by row, column and value; a heavy row is spread over tasks."""
    return ranked(entries.select("matrix", "i", "j", "v"), ["matrix"], ["i", "j", "v"], "pos")


def _packed(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (matrix, i, j, v) in order: their segments, closed where no other partition can have a part of them, else open.

    A partition's first group may have begun before it, so all its segments are open and
    count from the partition's start; so is its last segment, which may go on.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # Rows of the segment that is not known to be full, from its first on, that one's place in its group, and whether that group is the partition's first.
        held, begun, first, at = None, 0, True, 0

        def made(rows: pa.RecordBatch, cuts: np.ndarray, run: np.ndarray, firsts: bool, is_open: bool) -> pa.RecordBatch:
            """The segments of rows between each cut and the next."""
            n, starts, size = len(cuts) - 1, cuts[:-1], np.diff(cuts)
            inner = rows.slice(cuts[0], cuts[-1] - cuts[0])
            cells = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.StructArray.from_arrays([inner.column(2), inner.column(3)], ["j", "v"]))
            none, heads = pa.nulls(n, cells.type), pa.array(starts)
            seg = pa.array((run[starts] // segment).astype(np.int32))
            place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(run[starts]), pa.array(run[starts] + size - 1), pa.array(np.full(n, firsts))]
            if not is_open:
                place = [pa.nulls(n, p.type) for p in place]
            both = [none, cells] if is_open else [cells, none]
            return pa.RecordBatch.from_arrays([rows.column(0).take(heads), rows.column(1).take(heads), seg, *both, *place], ["matrix", "i", "seg", "cells", "rest", "_part", "_at", "_start", "_run", "_first"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(held.columns, batch.columns)], batch.schema.names)
            n = rows.num_rows
            starts = np.zeros(n, bool)
            for k in range(2):
                starts[1:] |= ~same_as_before(rows.column(k))
            places = np.arange(n)
            run = places - np.maximum.accumulate(np.where(starts, places, -begun))
            cuts = np.flatnonzero(starts | (run % segment == 0))
            # Segments before the second group belong to the partition's first, if the batch began in it.
            head = int(np.searchsorted(cuts, np.argmax(starts) if starts.any() else n)) if first else 0
            head = min(head, len(cuts) - 1)
            if head:
                yield made(rows, cuts[: head + 1], run, True, True)
                at += head
            if head < len(cuts) - 1:
                yield made(rows, cuts[head:], run, False, False)
                at += len(cuts) - 1 - head
            first = first and not starts.any()
            held, begun = rows.slice(cuts[-1]), int(run[cuts[-1]])
        if held is not None:
            run = begun + np.arange(held.num_rows)
            yield made(held, np.array([0, held.num_rows]), run, first, True)

    return each


def csr_pack(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(matrix, i, seg, cells): each row as arrays of (j, v) in order, at most `segment` entries in one.

    Repeated entries and explicit zeros each have a cell. A null matrix or row is packed
    like any other, null columns and values come first in their order. Empty rows and
    no entries give no rows.

    Rows are packed where ranges of all entries lie in order. What may go on in another
    range, a range's first row and last segment, is cut and put together again once a
    carry table of one row per range says how many entries lie in the ranges before.
    """
    slim = entries.select("matrix", "i", "j", "v")
    matrix, i, j, v = (slim.schema[c].dataType.simpleString() for c in slim.columns)
    cells = f"array<struct<j: {j}, v: {v}>>"
    schema = f"matrix {matrix}, i {i}, seg int, cells {cells}, rest {cells}, _part int, _at long, _start long, _run long, _first boolean"
    # Rows may come in any order, so a number decides the ranges and nearly all of the sort: bits of the matrix's hash and the least bits of the row. Names that begin alike are slow to sort by.
    number = F.shiftleft(F.xxhash64("matrix"), 44) + F.coalesce(F.pmod(F.col("i").cast("long"), F.lit(1 << 44)), F.lit(0))
    ordered = in_ranges(slim.withColumn("_number", number), ["_number", *slim.columns]).select(*slim.columns)
    found = written(ordered.mapInArrow(_packed(segment), schema), "packed")
    carries = written(carries_of(found.where("_part is not null"), ["matrix", "i"]), "carries")
    opened = found.where("_part is not null").join(F.broadcast(carries), "_part")
    start = F.col("_start") + F.when(F.col("_first"), F.col("_carry")).otherwise(F.lit(0))
    room = (F.lit(segment) - F.col("start") % segment).cast("int")
    seg = F.floor(F.col("start") / segment).cast("int")
    pieces = F.array(
        F.struct(seg.alias("seg"), F.col("start"), F.slice("rest", F.lit(1), room).alias("cells")),
        F.struct((seg + 1).alias("seg"), (F.col("start") + room).alias("start"), F.slice("rest", room + 1, F.lit(segment)).alias("cells")),
    )
    pieces = opened.withColumn("start", start).select("matrix", "i", F.explode(F.filter(pieces, lambda p: F.size(p["cells"]) > 0)).alias("p"))
    pieces = pieces.select("matrix", "i", "p.seg", F.struct("p.start", "p.cells").alias("piece"))
    mended = pieces.groupBy("matrix", "i", "seg").agg(F.flatten(F.sort_array(F.collect_list("piece"))["cells"]).alias("cells"))
    return found.where("_part is null").select("matrix", "i", "seg", "cells").unionByName(mended)


def csr_unpack(packed: DataFrame) -> DataFrame:
    """(matrix, i, j, v): the entries of packed rows."""
    return packed.select("matrix", "i", F.inline("cells"))
