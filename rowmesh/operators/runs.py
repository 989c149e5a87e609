"""Statistics of benchmark runs: runs(matrix, variant, ..., ms) with one row per sample.

A configuration is named by `by`, its columns besides the matrix; one value of the
variant is the baseline. Samples are money-like decimals of `scale` places, so that
sums don't depend on their order. What is no such number (null, NaN, infinite) is no
sample: it counts nowhere, and a configuration without a sample has no row. A ratio
over a mean of zero is null, and what is judged by it is null too. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmesh.functions.ranking import ranked
from rowmesh.functions.storage import written

SCALE = 6
#: Samples of a configuration that are gathered in one row; larger ones are selected from.
LISTED = 1 << 16
#: Larger configurations that every task holds, at most.
BROADCAST_GROUPS = 100_000
#: The sketch's rank is off by at most the samples over this.
_ACCURACY = 10_000


def samples(runs: DataFrame, value: str = "ms", scale: int = SCALE) -> DataFrame:
    """The rows of runs with a sample."""
    return runs.where(F.col(value).try_cast(f"decimal(28,{scale})").isNotNull())


def p90_rank(n: Column) -> Column:
    """0-based place of the nearest-rank 90th percentile among n: floor(0.9 n), always below n."""
    return F.call_function("div", n * 9, F.lit(10))


def _half(n: Column) -> Column:
    return F.call_function("div", n, F.lit(2))


def order_statistics(runs: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """(*by, n, median, p90): the values at places floor(n / 2) and floor(0.9 n) of the sorted samples."""
    return statistics(runs, by, value).select(*by, "n", "median", "p90")


def statistics(runs: DataFrame, by: list[str], value: str = "ms", scale: int = SCALE) -> DataFrame:
    """(*by, n, total, mean, median, p90) of each configuration, what all reports are made of; see order_statistics().

    Samples of a configuration are gathered by one shuffle and picked from in order.
    A configuration of more than LISTED samples is not: a sketch of bounded error tells
    between which values the wanted ones lie, those below are counted, and only the
    samples between, a thousandth of all, are ranked. The result is exact either way.
    """
    rows = samples(runs, value).select(*by, value, F.struct(F.lit(0).alias("one"), *by).alias("_group"))
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > LISTED).select("_group", "n"), "large-groups")
    n_large = large.limit(BROADCAST_GROUPS + 1).count()
    in_order = F.sort_array(F.collect_list(value))
    pick = lambda place: F.get(F.col("_all"), place.cast("int"))
    listed = rows if not n_large else rows.join(_few(large, n_large), "_group", "left_anti")
    found = listed.groupBy(*by).agg(F.count(value).alias("n"), _total(value, scale).alias("total"), in_order.alias("_all"))
    found = found.select(*by, "n", "total", pick(_half(F.col("n"))).alias("median"), pick(p90_rank(F.col("n"))).alias("p90"))
    if n_large:
        found = found.unionByName(_selected(rows.join(_few(large, n_large).select("_group"), "_group", "left_semi"), by, value, scale, n_large))
    return found.select(*by, "n", "total", _mean(F.col("total"), F.col("n")).alias("mean"), "median", "p90")


def _few(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= BROADCAST_GROUPS else groups


def _selected(rows: DataFrame, by: list[str], value: str, scale: int, n_groups: int) -> DataFrame:
    """(*by, n, total, median, p90) by selection: rows outside the sketch's bounds are counted only."""
    wide = 4 / _ACCURACY
    around = F.percentile_approx(value, [0.5 - wide, 0.5 + wide, 0.9 - wide, 0.9 + wide], _ACCURACY)
    sums = written(rows.groupBy("_group").agg(F.count(value).alias("n"), _total(value, scale).alias("total"), around.alias("_ends")), "bounds")
    ends = [(0, _half(F.col("n"))), (1, p90_rank(F.col("n")))]
    bounds = sums.select("_group", F.inline(F.array(*[F.struct(F.lit(k).alias("_which"), F.get("_ends", F.lit(2 * k)).alias("_lo"), F.get("_ends", F.lit(2 * k + 1)).alias("_hi"), place.cast("long").alias("_place")) for k, place in ends])))
    both = rows.select("_group", F.col(value).alias("_value")).join(_few(bounds, 2 * n_groups), "_group")
    below = both.groupBy("_group", "_which").agg(F.count(F.when(F.col("_value") < F.col("_lo"), 1)).alias("_below"))
    inside = both.where(F.col("_value").between(F.col("_lo"), F.col("_hi"))).select("_group", "_which", "_place", "_value").withColumn("_key", F.to_json("_group", {"ignoreNullFields": "false"}))
    placed = ranked(inside, ["_key", "_which"], ["_value"], "_rank").join(_few(below, 2 * n_groups), ["_group", "_which"])
    wanted = placed.where(F.col("_rank") == F.col("_place") - F.col("_below"))
    found = wanted.groupBy("_group").agg(*[F.max(F.when(F.col("_which") == k, F.col("_value"))).alias(name) for k, name in enumerate(("median", "p90"))])
    return sums.join(found, "_group").select(*[F.col(f"_group.{c}").alias(c) for c in by], "n", "total", "median", "p90")


def p90_nearest_rank(runs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, p90)."""
    return order_statistics(runs, by).drop("median")


def _total(value: str, scale: int) -> Column:
    return F.sum(F.col(value).try_cast(f"decimal(28,{scale})"))


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n)


def mean_of(value: str = "ms", scale: int = SCALE) -> Column:
    """Mean through an exact decimal sum."""
    return _mean(_total(value, scale), F.count(value))


def run_mean(runs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, mean)."""
    return samples(runs).groupBy(*by).agg(F.count("ms").alias("n"), mean_of().alias("mean"))


def _with_gains(stats: DataFrame, baseline: str, scope: tuple[str, ...]) -> DataFrame:
    """stats(variant, n, total, mean, ...) with base_mean and speedup, over the baseline's samples in the same scope; what has no baseline goes. The configurations of a scope are few."""
    here, base = Window.partitionBy(*scope), F.col("variant") == baseline
    base_mean = _mean(F.sum(F.when(base, F.col("total"))).over(here), F.sum(F.when(base, F.col("n"))).over(here))
    return stats.withColumn("base_mean", base_mean).where("base_mean is not null").withColumn("speedup", F.try_divide("base_mean", "mean"))


def speedup(runs: DataFrame, baseline: str, by: tuple[str, ...] = ("variant",), scope: tuple[str, ...] = ("matrix",)) -> DataFrame:
    """(*scope, *by, mean, base_mean, speedup) of each configuration but the baseline; the baseline's mean is that within `scope`.

    A scope of the matrix compares with one baseline for all; with what names a result
    file too (schedule, threads) each file is compared with the baseline it holds.
    """
    keys = [*dict.fromkeys(["matrix", *scope, *by])]
    means = samples(runs).groupBy(*keys).agg(F.count("ms").alias("n"), _total("ms", SCALE).alias("total"), mean_of().alias("mean"))
    return _with_gains(means, baseline, scope).where(F.col("variant") != baseline).select(*keys, "mean", "base_mean", "speedup")


def best_config(runs: DataFrame, baseline: str, ordinal: Column, within: tuple[str, ...] = ("matrix",)) -> DataFrame:
    """The configuration with the least mean of each `within`; of equal ones the first by ordinal. The variants of a matrix are few."""
    first = Window.partitionBy(*within).orderBy("mean", "ordinal")
    found = speedup(runs, baseline).withColumn("ordinal", ordinal)
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def summary_report(runs: DataFrame, baseline: str, ordinal: Column) -> DataFrame:
    """(matrix, variant, ordinal, n, mean, p90, speedup, best): the baseline as 0 with speedup 1, then the variants by ordinal. All of it comes from one table of statistics()."""
    base = F.col("variant") == baseline
    gains = _with_gains(statistics(runs, ["matrix", "variant"]), baseline, ("matrix",)).where("variant is not null")
    gains = gains.withColumns({"ordinal": F.when(base, 0).otherwise(ordinal.cast("int")), "speedup": F.when(base, 1.0).otherwise(F.col("speedup"))})
    first = F.row_number().over(Window.partitionBy("matrix").orderBy(base, "mean", "ordinal")) == 1
    return gains.withColumn("best", first & ~base).select("matrix", "variant", "ordinal", "n", "mean", "p90", "speedup", "best").orderBy("matrix", "ordinal")


def sweep_coverage(matrices: DataFrame, dimensions: dict[str, Column], observed: DataFrame) -> DataFrame:
    """Cells of the grid matrices x dimensions without an observed run; each dimension is an array column, its values known beforehand."""
    grid = matrices.select("matrix").distinct()
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(values))
    return grid.join(observed.select("matrix", *dimensions).distinct(), ["matrix", *dimensions], "left_anti")


def sparsity_profile(entries: DataFrame, counts: DataFrame, ncols: DataFrame) -> DataFrame:
    """One row per matrix from its entries, row counts(matrix, i, n) and ncols(matrix, ncols).

    The deviation of the row counts is over all rows and comes from whole-number
    sums. mirrored is the share of entries whose mirrored place holds an entry too.
    """
    rows = counts.groupBy("matrix").agg(
        F.count(F.lit(1)).alias("nrows"), F.sum("n").alias("nnz"), F.min("n").alias("min_row"), F.max("n").alias("max_row"),
        F.sum((F.col("n") == 0).cast("long")).alias("empty_rows"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    # One exchange of the entries: those of a place and of its mirror meet at the pair of both.
    i, j = F.col("i"), F.col("j")
    pairs = entries.groupBy("matrix", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(
        F.count_if(i < j).alias("above"), F.count_if(i > j).alias("below"), F.count_if(i == j).alias("on")
    )
    both = F.when((F.col("above") > 0) & (F.col("below") > 0), F.col("above") + F.col("below")).otherwise(F.lit(0))
    spread = pairs.groupBy("matrix").agg(F.max(F.col("high") - F.col("low")).alias("bandwidth"), F.sum("on").alias("diagonal"), F.sum(both + F.col("on")).alias("paired"))
    all_of = rows.join(ncols, "matrix").join(spread, "matrix", "left")
    mean = F.col("nnz") / F.col("nrows")
    return all_of.select(
        "matrix", "nrows", "ncols", "nnz", (F.col("nnz") / F.col("nrows") / F.col("ncols")).alias("density"), "min_row", "max_row", mean.alias("mean_row"),
        F.sqrt(F.col("squares") / F.col("nrows") - mean * mean).alias("stddev_row"), "empty_rows", F.coalesce("bandwidth", F.lit(0)).alias("bandwidth"),
        F.coalesce("diagonal", F.lit(0)).alias("diagonal"), (F.coalesce("paired", F.lit(0)) / F.greatest("nnz", F.lit(1))).alias("mirrored"),
    )


def schedule_eval(runs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Means and least samples over the rollup of the dimensions, with grouping id, and the rank of each cell by mean under its parent."""
    rolled = samples(runs).rollup(*dimensions).agg(F.grouping_id().alias("level"), F.count("ms").alias("n"), mean_of().alias("mean"), F.min("ms").alias("least"))
    under = Window.partitionBy("level", *dimensions[:-1]).orderBy("mean")
    # Only the finest cells compete: those of one parent are few.
    return rolled.withColumn("place", F.when(F.col("level") == 0, F.rank().over(under)))


def bottlenecks(runs: DataFrame, baseline: str, threads: Column, nnz: Column | DataFrame | None = None) -> DataFrame:
    """Efficiency of each variant and what stands out: slower than the baseline, a heavy tail (p90 over twice the median), a mean above p90, no gain over the next fewer threads.

    With nnz, a column or a table (matrix, nnz), throughput is what two operations an
    entry come to; a matrix that the table doesn't name has none.
    """
    stats = _with_gains(statistics(runs, ["matrix", "variant"]), baseline, ("matrix",)).where(F.col("variant") != baseline).withColumn("threads", threads)
    if isinstance(nnz, DataFrame):
        stats, nnz = stats.join(nnz.select("matrix", "nnz"), "matrix", "left"), F.col("nnz")
    fewer = F.lag("speedup").over(Window.partitionBy("matrix").orderBy("threads", "variant"))
    return stats.select(
        "matrix", "variant", "threads", "speedup", F.try_divide("speedup", "threads").alias("efficiency"), (F.col("speedup") < 1).alias("slower"),
        (F.col("p90") > 2 * F.col("median")).alias("tail_heavy"), (F.col("mean") > F.col("p90")).alias("outlier"), F.coalesce(F.col("speedup") <= fewer, F.lit(False)).alias("flat"),
        *([F.try_divide(2 * nnz, F.col("mean")).alias("throughput")] if nnz is not None else []),
    )
