"""Matrix-vector products y = A x in several partitionings; each gives a row for every i of the domain, 0.0 for empty rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.functions.storage import written

from .layout import row_ptr

#: Most entries of x that are sent to every task (some 32 bytes each).
BROADCAST_X = 2_000_000
#: Columns of one block of a tiled product: an array of half a megabyte.
COLUMN_BLOCK = 1 << 16
#: Most places of x's arrays that are joined to each tile, holes included; a join writes the array into every row.
BROADCAST_PLACES = 4096
#: Shares that the tiles of a block are dealt to, each with a copy of the block's array, and cells that are cut at a time.
SHARES, BATCH_CELLS = 8, 1 << 20
#: A column is heavy if it has more than 1 / _SHARE of an even partition's entries; so there are at most _SHARE heavy ones for each partition.
_SHARE = 4


def dense_vector(spark: SparkSession, matrix: str, ncols: int, seed: int = 0) -> DataFrame:
    """(matrix, j, x): uniform in [0, 10), decided by the seed and the column alone."""
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) * F.lit(2.0**-53)
    return spark.range(ncols).select(F.lit(matrix).alias("matrix"), F.col("id").alias("j"), (share * 10).alias("x"))


def column_vector(columns: DataFrame) -> DataFrame:
    """(matrix, j, x) over columns(matrix, j): a vector that the column number alone decides."""
    return columns.select("matrix", "j", (F.pmod(F.col("j") * 7919, F.lit(1000)) / 100).alias("x"))


def _over_domain(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """(matrix, i, y): the sums of parts(matrix, i, y) for every row of the domain, and for no other.

    The domain comes in as rows of 0.0, so one shuffle, of partial sums, gives both
    the sums and the empty rows.
    """
    zeros = rows.select("matrix", "i", F.lit(0.0).alias("y"), F.lit(True).alias("known"))
    both = parts.select("matrix", "i", "y", F.lit(False).alias("known")).unionByName(zeros)
    return both.groupBy("matrix", "i").agg(F.sum("y").alias("y"), F.max("known").alias("known")).where("known").drop("known")


def _vector(x: DataFrame) -> DataFrame:
    """x(matrix, j, x) without what has no column or value."""
    return x.select("matrix", "j", "x").where("j is not null and x is not null")


def spmv(entries: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """(matrix, i, y): sums of v x over the entries of each row, partial before the shuffle on i.

    An x of up to BROADCAST_X entries goes to every task. A larger one is joined on the
    column; columns with more entries than a quarter of a partition's share are told
    beforehand, and only their entries of x, whose number this bounds, are broadcast:
    the entries that would make a partition too large are not moved. Null keys, values
    and entries without an x count nothing; entries and x that repeat count each.
    """
    x = _vector(x)
    if x.limit(BROADCAST_X + 1).count() <= BROADCAST_X:
        parts = entries.join(F.broadcast(x), ["matrix", "j"])
        return _over_domain(parts.select("matrix", "i", (F.col("v") * F.col("x")).alias("y")), rows)
    counts = entries.groupBy("matrix", "j").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(counts, "column-counts")
    most = _SHARE * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = (sizes.agg(F.sum("n")).first()[0] or 0) // most + 1
    heavy = F.broadcast(sizes.where(F.col("n") >= least).select("matrix", "j"))
    here = entries.join(F.broadcast(x.join(heavy, ["matrix", "j"], "left_semi")), ["matrix", "j"])
    moved = entries.join(heavy, ["matrix", "j"], "left_anti").join(x, ["matrix", "j"])
    both = here.select("matrix", "i", "v", "x").unionByName(moved.select("matrix", "i", "v", "x"))
    return _over_domain(both.select("matrix", "i", (F.col("v") * F.col("x")).alias("y")), rows)


def column_blocks(x: DataFrame, block: int = COLUMN_BLOCK) -> DataFrame:
    """(matrix, block, first, xs): x as arrays over the columns from `first` on, null where a column has no entry; entries that repeat are summed."""
    sums = _vector(x).groupBy("matrix", "j").agg(F.sum("x").alias("x")).withColumn("block", F.expr(f"j div {int(block)}"))
    lists = sums.groupBy("matrix", "block").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("cells"))
    # Columns without an entry between two others come in as nulls, so that places in an array are columns.
    missing = lambda c, k: c["j"] - F.coalesce(F.get("cells", k - 1)["j"], c["j"] - 1) - 1
    filled = F.transform("cells", lambda c, k: F.concat(F.array_repeat(F.lit(None).cast("double"), missing(c, k).cast("int")), F.array(c["x"])))
    return lists.select("matrix", "block", F.get("cells", F.lit(0))["j"].alias("first"), F.flatten(filled).alias("xs"))


def _places(x: DataFrame, block: int) -> int:
    """How many places the arrays of column_blocks() have, holes included."""
    spans = _vector(x).groupBy("matrix", F.expr(f"j div {int(block)}").alias("block")).agg((F.max("j") - F.min("j") + 1).alias("n"))
    return spans.agg(F.sum("n")).first()[0] or 0


def tiles(packed: DataFrame, block: int = COLUMN_BLOCK) -> DataFrame:
    """(matrix, block, i, cells): packed rows cut where a block of columns ends; a segment that lies in one block stays as it is."""
    of = lambda c: F.call_function("div", c["j"], F.lit(block))
    ordered = packed.where(F.size("cells") > 0).select("matrix", "i", F.filter("cells", lambda c: c["j"].isNotNull()).alias("cells"))
    n = F.size("cells")
    at = lambda k: of(F.get("cells", k))
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (at(k) != at(k - 1)))
    cut = ordered.where(n > 0).withColumn("starts", F.when(at(F.lit(0)) == at(n - 1), F.array(F.lit(0))).otherwise(starts))
    upto = lambda k: F.coalesce(F.get("starts", k + 1), n)
    pieces = F.transform("starts", lambda s, k: F.struct(at(s).alias("block"), F.slice("cells", s + 1, upto(k) - s).alias("cells")))
    return cut.select("matrix", "i", F.explode(pieces).alias("t")).select("matrix", "t.block", "i", "t.cells")


def _cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows (matrix, i, cells) as tiles, those of one block of columns and one batch in a row: their i, lengths, columns from the block's start on, and values as bytes.

    Cells without a column or value count nothing and are left out. Rows are dealt to shares in turn.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = TaskContext.get().partitionId()
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(sizes)
            # Some million cells at a time.
            ends = np.r_[np.flatnonzero(np.diff(upto // BATCH_CELLS)) + 1, len(sizes)]
            for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                part, n = batch.slice(lo, hi - lo), sizes[lo:hi]
                j, v = part.column(2).flatten().flatten()
                keep = pc.and_(pc.is_valid(j), pc.is_valid(v))
                row = np.repeat(np.arange(hi - lo), n)[keep.to_numpy(zero_copy_only=False)]
                if not len(row):
                    continue
                j = j.filter(keep).cast(pa.int64()).to_numpy(zero_copy_only=False)
                v = v.filter(keep).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                # As Spark's div, towards zero.
                at = np.where(j < 0, -(-j // block), j // block)
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
                lengths, names = np.diff(np.r_[starts, len(row)]), part.column(0).dictionary_encode()
                name, tile_at = names.indices.to_numpy(zero_copy_only=False)[row[starts]], at[starts]
                order = np.lexsort((tile_at, name))
                starts, lengths, name, tile_at = starts[order], lengths[order], name[order], tile_at[order]
                before = np.cumsum(lengths) - lengths
                cells = np.repeat(starts - before, lengths) + np.arange(len(row))
                places, v, rows = (j - at * block)[cells].astype(np.int32), v[cells], part.column(1).take(pa.array(row[starts]))
                none, i = rows.is_null().to_numpy(zero_copy_only=False), pc.fill_null(rows.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                groups = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (tile_at[1:] != tile_at[:-1])])
                tiles, cells = np.r_[groups, len(name)], np.r_[before[groups], len(row)]
                held = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for x, cut in ((i, tiles), (none, tiles), (lengths.astype(np.int32), tiles), (places, cells), (v, cells))]
                shares = (share + np.arange(len(groups))) % SHARES
                share += len(groups)
                head = [names.dictionary.take(pa.array(name[groups])), pa.array(tile_at[groups]), pa.array(shares.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(x, pa.binary()) for x in held]], ["matrix", "block", "share", "i", "none", "lengths", "places", "v"])

    return each


def _multiplied(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _cut() behind the array of their block of x: (matrix, i, y) of each tile."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, xs, known = None, 0, None, None
        for batch in batches:
            keys = list(zip(batch.column("matrix").to_pylist(), batch.column("block").to_pylist()))
            sums, rows, none, names = [], [], [], []
            for k in range(batch.num_rows):
                if batch.column("xs")[k].is_valid:
                    values = batch.column("xs")[k].values
                    key, first, known = keys[k], batch.column("first")[k].as_py(), values.is_valid().to_numpy(zero_copy_only=False)
                    xs = np.where(known, values.to_numpy(zero_copy_only=False), 0.0)
                elif keys[k] == key:
                    i, no, lengths, places, v = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("i", np.int64), ("none", bool), ("lengths", np.int32), ("places", np.int32), ("v", np.float64)))
                    places = places.astype(np.int64) + (key[1] * block - first)
                    there = (places >= 0) & (places < len(xs))
                    places[~there] = 0
                    with np.errstate(all="ignore"):
                        products = np.where(there & known[places], v * xs[places], 0.0)
                        # Added up one by one, in order.
                        sums.append(np.bincount(np.repeat(np.arange(len(i)), lengths), products, len(i)))
                    rows.append(i)
                    none.append(no)
                    names.append((key[0], len(i)))
            if sums:
                matrix = pa.concat_arrays([pa.repeat(pa.scalar(m, batch.schema.field("matrix").type), n) for m, n in names])
                yield pa.RecordBatch.from_arrays([matrix, pa.array(np.concatenate(rows), mask=np.concatenate(none)), pa.array(np.concatenate(sums))], ["matrix", "i", "y"])

    return each


def _beside_blocks(packed: DataFrame, arrays: DataFrame, block: int) -> DataFrame:
    """(matrix, i, y): the sum of each tile, where tiles and the arrays of their blocks lie in one partition.

    A block is dealt to SHARES shares, each with its array, so that one with most cells is
    spread over tasks. Tasks hold one array and one batch of tiles, whatever a block has of them.
    """
    name, row = packed.schema["matrix"].dataType.simpleString(), packed.schema["i"].dataType
    slim = packed.where("matrix is not null and size(cells) > 0").select("matrix", "i", "cells")
    cut = slim.mapInArrow(_cut(block), f"matrix {name}, block long, share int, i binary, none binary, lengths binary, places binary, v binary")
    shares = F.explode(F.array(*map(F.lit, range(SHARES)))).alias("share")
    both = arrays.where("matrix is not null").select("matrix", "block", "first", "xs", shares).unionByName(cut, allowMissingColumns=True)
    keys = ["matrix", "block", "share"]
    # A number of partitions, as Spark would put together those whose bytes compress well, and sort them at full length.
    most = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(most, *keys).sortWithinPartitions(*keys, F.col("xs").isNull())
    return met.mapInArrow(_multiplied(block), f"matrix {name}, i long, y double").withColumn("i", F.col("i").cast(row))


def spmv_packed(packed: DataFrame, x: DataFrame, rows: DataFrame, block: int = COLUMN_BLOCK) -> DataFrame:
    """(matrix, i, y) row by row over the packed arrays, in tiles: each looks its entries of x up in the array of its block of columns.

    x stays in tables, an array for each block. Arrays that, holes included, have up to
    BROADCAST_PLACES places are joined to each tile as columns are; larger ones meet the
    tiles of their block, packed as they are, in a shuffle, as a join would copy the array
    for each tile. The tiles, the arithmetic and so the result are the same. What counts is
    as in spmv(). x never reaches the driver but for broadcasts of that size.
    """
    arrays = column_blocks(x, block)
    if _places(x, block) > min(BROADCAST_X, BROADCAST_PLACES):
        return _over_domain(_beside_blocks(packed, arrays, block), rows)
    product = lambda c: F.coalesce(c["v"] * F.get("xs", (c["j"] - F.col("first")).cast("int")), F.lit(0.0))
    y = F.aggregate("cells", F.lit(0.0), lambda sum_of, c: sum_of + product(c))
    return _over_domain(tiles(packed, block).join(F.broadcast(arrays), ["matrix", "block"]).select("matrix", "i", y.alias("y")), rows)


def spmv_parallel(entries: DataFrame, x: DataFrame, rows: DataFrame, workers: int | None = None, by: tuple[str, ...] = ("matrix", "i")) -> DataFrame:
    """(matrix, i, y) with the entries in `workers` ranges of about equal size; for one matrix, by=("i",) will do.

    Ranges go on by column within a row, so one that holds a third of all entries is
    dealt to several tasks too. As rows lie together, what is shuffled after that is
    about one partial sum for each row. An x of more than BROADCAST_X entries is joined
    on the column first, where ranges of rows would be lost again.
    """
    workers = workers or entries.sparkSession.sparkContext.defaultParallelism
    if _vector(x).limit(BROADCAST_X + 1).count() > BROADCAST_X:
        return spmv(entries, x, rows)
    return spmv(entries.repartitionByRange(workers, *by, "j"), x, rows)


def block_worker(chunk: int, workers: int):
    """The worker of row i when blocks of `chunk` rows are dealt in turn."""
    return F.expr(f"pmod(i div {int(chunk)}, {int(workers)})").cast("int")


def spmv_row_blocks(entries: DataFrame, x: DataFrame, rows: DataFrame, chunk: int = 50, workers: int | None = None) -> DataFrame:
    """(matrix, i, y). Which task sums a row is left to Spark; how even blocks of `chunk` rows would be is row_block_load()."""
    return spmv(entries, x, rows)


def row_block_load(entries: DataFrame, chunk: int = 50, workers: int = 16) -> DataFrame:
    """(matrix, w, n_entries, first_row, last_row, imbalance): what each worker would get; imbalance is the greatest load over the mean."""
    loads = entries.groupBy("matrix", block_worker(chunk, workers).alias("w")).agg(F.count(F.lit(1)).alias("n_entries"), F.min("i").alias("first_row"), F.max("i").alias("last_row"))
    whole = loads.groupBy("matrix").agg((F.max("n_entries") * workers / F.sum("n_entries")).alias("imbalance"))
    return loads.join(whole, "matrix")


def balanced_groups(entries: DataFrame, rows: DataFrame, workers: int = 16) -> DataFrame:
    """(matrix, i, n, p): contiguous groups of rows with about as many entries each."""
    pointers = row_ptr(entries, rows)
    total = pointers.groupBy("matrix").agg(F.greatest(F.sum("n"), F.lit(1)).alias("nnz"))
    p = F.expr(f"least({int(workers) - 1}, ptr * {int(workers)} div nnz)").cast("int")
    return pointers.join(total, "matrix").select("matrix", "i", "n", p.alias("p"))


def spmv_balanced(entries: DataFrame, x: DataFrame, rows: DataFrame, workers: int | None = None, schedule: str = "balanced", chunk: int = 50) -> DataFrame:
    """(matrix, i, y). 'balanced' and 'range' give ranges of about as many entries each, 'blocks' leaves the rows to Spark; the result is the same."""
    if schedule == "blocks":
        return spmv_row_blocks(entries, x, rows, chunk, workers)
    if schedule in ("range", "balanced"):
        return spmv_parallel(entries, x, rows, workers)
    raise ValueError(f"schedule is 'balanced', 'blocks' or 'range', not {schedule!r}")
