"""Layouts, products and statistics on small tables: equal ways, edges, heavy rows."""

import random

import pytest
from pyspark.sql import functions as F

from rowmesh.functions.ranking import exclusive_sum, ranked
from rowmesh.operators import layout, runs, spmv


def small(spark, seed=1):
    """Two matrices, one with a row that holds most entries and rows without any; whole numbers, so that sums are exact."""
    rng = random.Random(seed)
    cells = [("A", 3 if rng.random() < 0.6 else rng.randrange(40), rng.randrange(9), float(rng.randrange(-4, 5))) for _ in range(300)] + [("B", 0, 0, 2.0), ("B", 0, 0, 2.0)]
    entries = spark.createDataFrame(cells, "matrix string, i long, j long, v double")
    rows = layout.row_domain(spark.createDataFrame([("A", 45), ("B", 2), ("C", 1)], "matrix string, nrows long"), 16)
    x = spark.createDataFrame([(m, j, float(j * j - 3)) for m in "ABC" for j in range(9)], "matrix string, j long, x double")
    y = {(m, i): 0.0 for m, n in (("A", 45), ("B", 2), ("C", 1)) for i in range(n)}
    for m, i, j, v in cells:
        y[m, i] += v * (j * j - 3)
    return cells, entries, rows, x, y


def as_dict(df):
    return {(r.matrix, r.i): r.y for r in df.collect()}


@pytest.mark.parametrize("workers", [1, 3, 8])
def test_products_agree(spark, workers):
    _, entries, rows, x, y = small(spark)
    assert as_dict(spmv.spmv(entries, x, rows)) == y
    assert as_dict(spmv.spmv_parallel(entries, x, rows, workers)) == y
    for schedule in ("balanced", "blocks", "range"):
        assert as_dict(spmv.spmv_balanced(entries, x, rows, workers, schedule)) == y
    with pytest.raises(ValueError):
        spmv.spmv_balanced(entries, x, rows, schedule="guided")


@pytest.mark.parametrize("limit", [4_000_000, 5])
@pytest.mark.parametrize("block", [spmv.COLUMN_BLOCK, 4, 1])
def test_packed_product(spark, monkeypatch, limit, block):
    monkeypatch.setattr(spmv, "BROADCAST_X", limit)
    _, entries, rows, x, y = small(spark)
    assert as_dict(spmv.spmv_packed(layout.csr_pack(entries, 7), x, rows, block)) == y
    assert as_dict(spmv.spmv(entries, x, rows)) == y


@pytest.mark.parametrize("limit", [4_000_000, 2])
def test_odd_vectors(spark, monkeypatch, limit):
    """Both products, with x broadcast or joined: a repeated column, missing ones, nulls; the same result in all four."""
    monkeypatch.setattr(spmv, "BROADCAST_X", limit)
    entries = spark.createDataFrame([("m", 0, 0, 2.0), ("m", 0, 3, 5.0), ("m", 0, 6, 1.0), ("m", 1, 3, 1.0), ("m", 1, None, 9.0), ("m", 1, 0, None), ("m", 2, 9, 4.0), ("m", 7, 0, 1.0), (None, 0, 0, 1.0)], "matrix string, i long, j long, v double")
    x = spark.createDataFrame([("m", 0, 1.0), ("m", 0, 10.0), ("m", 6, 3.0), ("m", 3, None), ("m", None, 8.0), ("m", 5, 100.0), ("n", 3, 1.0)], "matrix string, j long, x double")
    rows = spark.createDataFrame([("m", i) for i in range(4)], "matrix string, i long")
    expected = {("m", 0): 25.0, ("m", 1): 0.0, ("m", 2): 0.0, ("m", 3): 0.0}
    assert as_dict(spmv.spmv(entries, x, rows)) == expected
    for block in (1, 4, spmv.COLUMN_BLOCK):
        assert as_dict(spmv.spmv_packed(layout.csr_pack(entries), x, rows, block)) == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_vector_with_holes(spark):
    """Places in an array are columns, from the block's first entry to its last; holes count as places, repeated entries once."""
    x = spark.createDataFrame([("m", 9, 1.0), ("m", 3, 2.0), ("m", 5, 4.0), ("m", 5, 0.5), ("m", 10, 3.0), ("m", 41, 7.0), ("m", None, 1.0), ("m", 40, None), (None, 2, 6.0)], "matrix string, j long, x double")
    got = {(r.matrix, r.block): (r.first, r.xs) for r in spmv.column_blocks(x, 10).collect()}
    assert got == {("m", 0): (3, [2.0, None, 4.5, None, None, None, 1.0]), ("m", 1): (10, [3.0]), ("m", 4): (41, [7.0]), (None, 0): (2, [6.0])}
    assert spmv._places(x, 10) == 10 and spmv._places(x.where("x > 100"), 10) == 0
    assert spmv.column_blocks(x.where("x > 100"), 10).count() == 0


def test_plans_of_products(spark, monkeypatch):
    """Packed rows aren't unpacked; columns with many entries are joined where they lie, others by the column."""
    _, entries, rows, x, _ = small(spark)
    packed = spmv.spmv_packed(layout.csr_pack(entries), x, rows)
    assert "inline" not in plan_of(packed) and "MapInArrow" not in plan_of(packed)
    monkeypatch.setattr(spmv, "BROADCAST_X", 2)
    n = 40_000
    hot = spark.range(n).select(F.lit("m").alias("matrix"), (F.col("id") % 97).alias("i"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4001).cast("long").alias("j"), F.lit(1.0).alias("v"))
    ones = spark.range(4001).select(F.lit("m").alias("matrix"), F.col("id").alias("j"), F.lit(2.0).alias("x"))
    domain = spark.range(97).select(F.lit("m").alias("matrix"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        product = spmv.spmv(hot, ones, domain)
        assert plan_of(product).count("BroadcastHashJoin") >= 2 and plan_of(product).count("SortMergeJoin") == 1
        assert sum(as_dict(product).values()) == 2.0 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plan_of_packing(spark):
    """One exchange by range before the ranks are fixed, and one by hash to gather the rows."""
    _, entries, _, _, _ = small(spark)
    plan = plan_of(layout.csr_pack(entries))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_groups_over_partition_borders(spark, partitions):
    """Groups shorter and longer than a partition, null and NaN keys, several columns."""
    rng = random.Random(partitions)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, float("nan"), 0.0, -0.0, 1.5]), rng.randrange(5), k) for k in range(300)] + [("z", 2.0, 1, 300 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, d double, o long, id long")
    seen, key = {}, lambda d: "nan" if d != d else d
    for r in ranked(df, ["g", "d"], ["o"], "k", partitions).collect():
        seen.setdefault((r.g, None if r.d is None else key(r.d)), []).append((r.k, r.o))
    for group in seen.values():
        group.sort()
        assert [k for k, _ in group] == list(range(len(group))) and [o for _, o in group] == sorted(o for _, o in group)
    assert sum(map(len, seen.values())) == 500 and len(seen) == len({(g, None if d is None else key(d)) for g, d, _, _ in rows})
    assert sorted(r.k for r in ranked(df, [], ["o"], "k", partitions).collect()) == list(range(500))


def test_layouts(spark):
    cells, entries, rows, _, _ = small(spark)
    place = {}
    for r in layout.csr_slots(entries).collect():
        place.setdefault(r.matrix, {})[r.pos] = (r.i, r.j, r.v)
    for m in "AB":
        assert [place[m][k] for k in range(len(place[m]))] == sorted(c[1:] for c in cells if c[0] == m)
    packed = layout.csr_pack(entries, 7).cache()
    assert max(len(r.cells) for r in packed.collect()) == 7
    assert sorted(map(tuple, layout.csr_unpack(packed).collect())) == sorted(cells)
    got = {(r.matrix, r.i): (r.n, r.ptr) for r in layout.row_ptr(entries, rows, 4).collect()}
    for m, n in (("A", 45), ("B", 2), ("C", 1)):
        at = 0
        for i in range(n):
            count = sum(c[:2] == (m, i) for c in cells)
            assert got[m, i] == (count, at)
            at += count
    assert [tuple(r) for r in layout.coo_sort(entries).collect()] == sorted(cells)


def test_ranks_are_spread_and_gapless(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.lit(None).cast("string")).alias("g"), F.lit(1).alias("v"), "id")
    out = ranked(df, ["g"], ["v"], "k", 8)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append(r.k)
    assert {g: sorted(k) for g, k in got.items()} == {"hot": list(range(900)), None: list(range(100))}
    assert ranked(df.limit(0), ["g"], ["v"]).count() == 0
    summed = exclusive_sum(spark.range(50).select(F.lit("m").alias("g"), "id", F.lit(2).alias("n")), "g", "id", "n", "s", 8)
    assert {r.id: r.s for r in summed.collect()} == {i: 2 * i for i in range(50)}


@pytest.mark.parametrize("n, place", [(1, 0), (9, 8), (10, 9), (15, 13), (100, 90)])
def test_nearest_rank(spark, n, place):
    df = spark.range(n).select(F.lit("m").alias("matrix"), F.lit("v").alias("variant"), (F.lit(n) - F.col("id")).cast("double").alias("ms"))
    r = runs.p90_nearest_rank(df, ["matrix", "variant"]).first()
    assert (r.n, r.p90) == (n, float(place + 1))


@pytest.mark.parametrize("listed", [runs.LISTED, 40, 0])
def test_order_statistics_of_large_groups(spark, monkeypatch, listed):
    """Groups gathered and groups selected from give the same: one with a third of all samples, ties, few values, a wide spread, nulls in the key."""
    monkeypatch.setattr(runs, "LISTED", listed)
    rng = random.Random(listed)
    rows = [("hot", "v", round(rng.lognormvariate(0, 4), 6)) for _ in range(4000)] + [("ties", "v", float(rng.randrange(3))) for _ in range(3000)] + [("same", None, 7.0)] * 2000
    rows += [(None, "v", float(k)) for k in range(41)] + [("few", "w", float(-k)) for k in range(3)] + [("hot", "w", 0.5)]
    groups = {}
    for m, v, ms in rows:
        groups.setdefault((m, v), []).append(ms)
    got = runs.statistics(spark.createDataFrame(rows, "matrix string, variant string, ms double").repartition(7), ["matrix", "variant"]).collect()
    expected = {k: (len(v), sorted(v)[len(v) // 2], sorted(v)[9 * len(v) // 10]) for k, v in groups.items()}
    assert {(r.matrix, r.variant): (r.n, r.median, r.p90) for r in got} == expected and len(got) == len(expected)
    assert all(abs(r["mean"] - sum(groups[r.matrix, r.variant]) / r.n) <= 1e-6 * max(1, abs(r["mean"])) for r in got)


def test_plans_of_reports(spark):
    """All figures of a report come from one table of statistics."""
    df = spark.createDataFrame([("m", "base", 4.0), ("m", "b", 2.0)], "matrix string, variant string, ms double")
    for out, most in ((runs.summary_report(df, "base", F.lit(1)), 3), (runs.bottlenecks(df, "base", F.lit(2)), 2), (runs.order_statistics(df, ["matrix"]), 1)):
        plan = plan_of(out)
        assert plan.count("Exchange ") <= most and "Join" not in plan
    entries = spark.createDataFrame([("m", 0, 1, 1.0)], "matrix string, i long, j long, v double")
    domain = spark.createDataFrame([("m", 0)], "matrix string, i long")
    profile = plan_of(runs.sparsity_profile(entries, layout.row_counts(entries, domain), domain.select("matrix", F.lit(2).alias("ncols"))))
    assert "LeftSemi" not in profile and profile.count("high#") > 0


def test_baseline_in_the_scope_of_a_file(spark):
    rows = [("m", "base", 4, 8.0), ("m", "base", 8, 6.0), ("m", "a", 4, 2.0), ("m", "a", 8, 3.0), ("m", "a", 16, 1.0)]
    df = spark.createDataFrame(rows, "matrix string, variant string, threads int, ms double")
    assert {(r.threads, r.speedup) for r in runs.speedup(df, "base", ("variant",), ("matrix", "threads")).collect()} == {(4, 4.0), (8, 2.0)}
    assert {(r.threads, r.base_mean) for r in runs.speedup(df, "base", ("variant", "threads")).collect()} == {(4, 7.0), (8, 7.0), (16, 7.0)}


def test_first_of_equal_configurations_wins(spark):
    df = spark.createDataFrame([("m", "base", 4.0), ("m", "b", 2.0), ("m", "a", 2.0), ("m", "c", 3.0)], "matrix string, variant string, ms double")
    order = F.when(F.col("variant") == "b", 1).when(F.col("variant") == "a", 2).otherwise(3)
    assert runs.best_config(df, "base", order).first().variant == "b"
    report = [(r.variant, r.ordinal, r.speedup, r.best) for r in runs.summary_report(df, "base", order).collect()]
    assert report == [("base", 0, 1.0, False), ("b", 1, 2.0, True), ("a", 2, 2.0, False), ("c", 3, 4 / 3, False)]


def test_random_vector_is_repeatable(spark):
    one, two = (spmv.dense_vector(spark, "m", 100, 5).collect() for _ in range(2))
    assert one == two and all(0 <= r.x <= 10 for r in one) and len({r.x for r in one}) == 100


def test_empty_matrices(spark):
    _, entries, rows, x, _ = small(spark)
    none = entries.limit(0)
    assert set(as_dict(spmv.spmv(none, x, rows)).values()) == set(as_dict(spmv.spmv_packed(layout.csr_pack(none), x, rows)).values()) == {0.0}
    assert layout.csr_pack(none).count() == layout.csr_slots(none).count() == 0
    profile = runs.sparsity_profile(none, layout.row_counts(none, rows), rows.groupBy("matrix").agg(F.count("i").alias("ncols"))).collect()
    assert {(r.matrix, r.nnz, r.empty_rows, r.bandwidth) for r in profile} == {("A", 0, 45, 0), ("B", 0, 2, 0), ("C", 0, 1, 0)}


def odd_runs(spark):
    rows = [("m", "base", 4.0), ("m", "base", None), ("m", "base", float("nan")), ("m", "zero", 0.0), ("m", "a", 2.0), ("m", "a", float("inf")), ("m", "none", None), ("n", "a", 1.0), (None, "a", 1.0)]
    return spark.createDataFrame(rows, "matrix string, variant string, ms double")


def test_odd_samples(spark):
    """Null, NaN and infinite samples count nowhere; a mean of zero gives no ratio."""
    df, by = odd_runs(spark), ["matrix", "variant"]
    means = {(r.matrix, r.variant): (r.n, r["mean"]) for r in runs.run_mean(df, by).collect()}
    assert means == {("m", "base"): (1, 4.0), ("m", "zero"): (1, 0.0), ("m", "a"): (1, 2.0), ("n", "a"): (1, 1.0), (None, "a"): (1, 1.0)}
    ranks = {(r.matrix, r.variant): (r.n, r.median, r.p90) for r in runs.order_statistics(df, by).where("matrix is not null").collect()}
    assert ranks == {k: (1, v[1], v[1]) for k, v in means.items() if k[0]}
    gains = {r.variant: r.speedup for r in runs.speedup(df, "base").collect()}
    assert gains == {"zero": None, "a": 2.0}
    order = F.when(F.col("variant") == "a", 1).otherwise(2)
    assert runs.best_config(df, "base", order).first().variant == "zero"
    report = {r.variant: (r.n, r.speedup, r.best) for r in runs.summary_report(df, "base", order).where("matrix = 'm'").collect()}
    assert report == {"base": (1, 1.0, False), "zero": (1, None, True), "a": (1, 2.0, False)}
    flags = {r.variant: (r.efficiency, r.slower, r.throughput) for r in runs.bottlenecks(df, "base", F.when(F.col("variant") == "a", 0).otherwise(4), F.lit(8)).collect()}
    assert flags == {"zero": (None, None, None), "a": (None, False, 8.0)}
    rolled = {(r.matrix, r.variant, r.level): (r.n, r.least) for r in runs.schedule_eval(df, by).collect()}
    assert rolled[None, None, 3] == (5, 0.0) and rolled["m", None, 1] == (3, 0.0)


def test_no_samples_at_all(spark):
    df, by = odd_runs(spark).limit(0), ["matrix", "variant"]
    for out in (runs.run_mean(df, by), runs.order_statistics(df, by), runs.speedup(df, "base"), runs.best_config(df, "base", F.lit(1)), runs.summary_report(df, "base", F.lit(1)), runs.bottlenecks(df, "base", F.lit(1))):
        assert out.count() == 0


def test_one_row_with_most_entries(spark):
    """A row that holds nearly all entries is dealt to several ranges."""
    entries = spark.range(20_000).select(F.lit("m").alias("matrix"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).cast("long").alias("i"), (F.col("id") % 1000).alias("j"), F.lit(1.0).alias("v"))
    x, rows = spark.range(1000).select(F.lit("m").alias("matrix"), F.col("id").alias("j"), F.lit(2.0).alias("x")), spark.range(20_000).select(F.lit("m").alias("matrix"), F.col("id").alias("i"))
    got = as_dict(spmv.spmv_parallel(entries, x, rows, 8))
    assert got == as_dict(spmv.spmv_packed(layout.csr_pack(entries, 100), x, rows)) and got["m", 7] == 2.0 * 19_800 and len(got) == 20_000


def test_vector_does_not_depend_on_partitions(spark):
    few = {r.j: r.x for r in spmv.dense_vector(spark, "m", 50, 5).coalesce(1).collect()}
    assert few == {r.j: r.x for r in spmv.dense_vector(spark, "m", 50, 5).repartition(7).collect()}


def test_packing_moves_only_what_borders_cut(spark):
    """Rows over several ranges, null and NaN keys, segments of several lengths against a plain version; whole rows are read back without a shuffle."""
    rng = random.Random(4)
    cells = [(rng.choice(["a", "b", None]), rng.choice([None, 7, 7, 7, rng.randrange(-50, 50)]), rng.choice([None, rng.randrange(100)]), rng.choice([None, float("nan"), float(rng.randrange(5))])) for _ in range(3000)]
    entries = spark.createDataFrame(cells, "matrix string, i long, j long, v double")
    order = lambda x: (x is not None, x != x, 0 if x is None or x != x else x)
    for segment in (1, 7, 100, layout.SEGMENT):
        rows, expected = {}, {}
        for m, i, j, v in cells:
            rows.setdefault((m, i), []).append((j, v))
        for key, found in rows.items():
            found.sort(key=lambda c: (order(c[0]), order(c[1])))
            expected |= {(*key, k // segment): repr(found[k : k + segment]) for k in range(0, len(found), segment)}
        packed = layout.csr_pack(entries, segment)
        got = packed.collect()
        assert len(got) == len(expected) and {(r.matrix, r.i, r.seg): repr([tuple(c) for c in r.cells]) for r in got} == expected
    plan = plan_of(packed)
    assert "Union" in plan and plan.count("isnotnull(_part") >= 1 and plan.count("isnull(_part") >= 1


def test_blocks_meet_tiles_without_a_join(spark):
    """An array of a block isn't written into the row of each tile; holes, what isn't finite, negative columns and rows without a number count as in spmv()."""
    n, inf, nan = 9000, float("inf"), float("nan")
    rng = random.Random(6)
    cells = [("m", rng.choice([3, rng.randrange(40)]), rng.randrange(n), float(rng.randrange(-4, 5))) for _ in range(4000)] + [("m", 41, 0, inf), ("m", 41, 5, inf), ("m", 42, 7, nan), ("m", None, 8, 2.0), ("m", 43, -3, 5.0), ("m", 43, n + 9, 5.0), ("other", 0, 8, 1.0)]
    entries = spark.createDataFrame(cells, "matrix string, i long, j long, v double")
    x = spark.createDataFrame([("m", j, float(j % 13)) for j in range(-4, n) if j % 1000 != 5], "matrix string, j long, x double")
    rows = spark.createDataFrame([("m", i) for i in [*range(44), None]] + [("other", 0)], "matrix string, i long")
    for block in (spmv.COLUMN_BLOCK, 1000):
        product = spmv.spmv_packed(layout.csr_pack(entries, 500), x, rows, block)
        assert not any("Join" in line and "block" in line for line in plan_of(product).splitlines())
        got = as_dict(product)
        assert repr(sorted(got.items(), key=repr)) == repr(sorted(as_dict(spmv.spmv(entries, x, rows)).items(), key=repr))
        assert got["m", None] == 16.0 and got["m", 43] == 50.0 and got["other", 0] == 0.0 and got["m", 42] != got["m", 42]


def test_domain_of_one_matrix_is_spread(spark):
    rows = layout.row_domain(spark.createDataFrame([("m", 1000)], "matrix string, nrows long"), 10)
    made = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == 1000
