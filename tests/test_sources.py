"""Coordinate text and result files on small fixtures with known answers."""

import math
import os

import pytest
from pyspark.sql import functions as F

from rowmesh.functions import storage
from rowmesh.operators import layout
from rowmesh.sources import csr_tables, matrix_market, run_files

HEAD = "%%MatrixMarket matrix coordinate {} {}\n"
FILES = {
    "general.mtx": HEAD.format("real", "general") + "% note\n\n3 4 5\n1 1 2.5\n1 4 -1\n3 2 1e3\n3 2 4\n1 2 0\n",
    "symmetric.mtx": HEAD.format("integer", "symmetric") + "3 3 3\n1 1 5\n2 1 7\n3 2 -2\n",
    "skew.mtx": HEAD.format("real", "skew-symmetric") + "3 3 2\n2 1 7\n3 1 1.5\n",
    "pattern.mtx": HEAD.format("pattern", "general") + "2 2 2\n1 2\n  2 1  \n",
    "complex.mtx": HEAD.format("complex", "general") + "1 1 1\n1 1 1 0\n",
    "hermitian.mtx": HEAD.format("real", "hermitian") + "1 1 1\n1 1 1\n",
    "bad.mtx": HEAD.format("real", "general") + "2 2 9\n1 1 x\n1 1\n1 2 3 4\n0 1 1\n1 3 1\n% late\n2 2 8\n99999999999999999999 1 1\n",
    "badsize.mtx": HEAD.format("real", "general") + "2 2\n1 1 1\n",
    "nosize.mtx": HEAD.format("real", "general") + "% only\n% comments\n",
    "empty.mtx": "",
    "short.mtx": "%%MatrixMarket matrix coordinate\n" + "%" + "c" * 400 + "\n2 2 3\n1 1 1\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("mm")
    for name, text in FILES.items():
        (path / name).write_text(text)
    return str(path)


def test_scan(spark, folder):
    got = {}
    for r in matrix_market.mm_scan(spark, folder).collect():
        got.setdefault(r.matrix, []).append((r.i, r.j, r.v))
    assert {k: sorted(v) for k, v in got.items()} == {
        "general": [(0, 0, 2.5), (0, 1, 0.0), (0, 3, -1.0), (2, 1, 4.0), (2, 1, 1000.0)],
        "symmetric": [(0, 0, 5.0), (1, 0, 7.0), (2, 1, -2.0)],
        "skew": [(1, 0, 7.0), (2, 0, 1.5)],
        "pattern": [(0, 1, 1.0), (1, 0, 1.0)],
        "bad": [(1, 1, 8.0)],
        "short": [(0, 0, 1.0)],
    }


def test_expansion(spark, folder):
    got = matrix_market.mm_entries(spark, folder).where("matrix in ('symmetric', 'skew')").collect()
    assert sorted((r.matrix, r.i, r.j, r.v) for r in got) == [
        ("skew", 0, 1, -7.0), ("skew", 0, 2, -1.5), ("skew", 1, 0, 7.0), ("skew", 2, 0, 1.5),
        ("symmetric", 0, 0, 5.0), ("symmetric", 0, 1, 7.0), ("symmetric", 1, 0, 7.0), ("symmetric", 1, 2, -2.0), ("symmetric", 2, 1, -2.0),
    ]


def test_catalog(spark, folder):
    got = {r.matrix: tuple(r)[1:] for r in matrix_market.mm_catalog(spark, folder).collect()}
    assert got["general"] == ("real", "general", 3, 4, 5, 5, 5)
    assert got["symmetric"] == ("integer", "symmetric", 3, 3, 3, 3, 5)
    assert got["skew"] == ("real", "skew-symmetric", 3, 3, 2, 2, 4)
    assert got["short"] == ("real", "general", 2, 2, 3, 1, 1)
    assert got["badsize"][2:] == (None, None, None, 0, 0)


def test_rejects(spark, folder):
    got = sorted((r.matrix, r.reason, r.line or "") for r in matrix_market.mm_rejects(spark, folder).collect())
    m = matrix_market
    assert got == sorted(
        [("bad", m.BAD_ENTRY, x) for x in ("1 1 x", "1 1", "1 2 3 4", "99999999999999999999 1 1")]
        + [("bad", m.OUT_OF_RANGE, x) for x in ("0 1 1", "1 3 1")]
        + [("bad", m.LATE_COMMENT, "% late"), ("badsize", m.BAD_SIZE, "2 2"), ("complex", m.UNSUPPORTED, "1 1 1 0"), ("hermitian", m.UNSUPPORTED, "1 1 1")]
        + [("nosize", m.NO_SIZE, ""), ("empty", m.NO_SIZE, "")]
    )


def test_a_file_in_many_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "big.mtx").write_text(HEAD.format("real", "general") + f"{n} 7 {n}\n" + "".join(f"{i + 1} {i % 7 + 1} {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = matrix_market.mm_scan(spark, str(tmp_path))
        assert matrix_market._lines(spark, str(tmp_path), "file").rdd.getNumPartitions() > 5
        assert sorted((r.i, r.j, r.v) for r in got.collect()) == [(i, i % 7, float(i)) for i in range(n)]
        assert matrix_market.mm_rejects(spark, str(tmp_path)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csr_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("A", 0, 1, 2.0), ("A", 0, 1, 2.0), ("A", 2, 0, 1.0), ("B", 1, 1, 5.0)], "matrix string, i long, j long, v double")
    sizes = spark.createDataFrame([("A", 3), ("B", 2)], "matrix string, nrows long")
    csr_tables.csr_write(entries, layout.row_domain(sizes), sizes, str(tmp_path / "m"))
    matrices, pointers, slots = csr_tables.csr_read(spark, str(tmp_path / "m"))
    assert matrices.count() == 2
    assert sorted((r.matrix, r.i, r.ptr, r.n) for r in pointers.collect()) == [("A", 0, 0, 2), ("A", 1, 2, 0), ("A", 2, 2, 1), ("B", 0, 0, 0), ("B", 1, 0, 1)]
    assert sorted((r.matrix, r.pos, r.i, r.j, r.v) for r in slots.collect()) == [("A", 0, 0, 1, 2.0), ("A", 1, 0, 1, 2.0), ("A", 2, 2, 0, 1.0), ("B", 0, 1, 1, 5.0)]


RULE = "=" * 20
LAYOUTS = {
    "LOCAL/RESULTS_m1_SEQUENTIAL.txt": "Matrix: m1\nTimes (ms):\n0.1\n0.2\n\nAverage: 0.150000 ms\n90th percentile: 0.200000 ms\n",
    "LOCAL/RESULTS_m1_PARALLEL.txt": "Matrix: m1\nTimes (ms):\n0.3\n\nAverage: 0.3 ms\n90th percentile: 0.3 ms\n",
    "CLUSTER/x/parallel/8_threads/RESULTS_m2_SEQ_vs_PAR.txt": "Matrix: m2\nMatrix size: 2 x 2, non_zero_val = 3\nNumber of runs: 2\n\nSEQUENTIAL VERSION (no #pragma):\n1.5\n2.5\nAverage: 2.0 ms\n90th percentile: 2.5 ms\n\n"
    "PARALLEL VERSION (with #pragma omp parallel for):\n0.5\n0.75\nAverage: 0.6 ms\n90th percentile: 0.75 ms\n\nSUMMARY:\nSequential Average:  2.0 ms\nParallel Average:    0.6 ms\nSpeedup:             3.33x\n",
    "CLUSTER/x/static/4_threads/RESULTS_m3_STATIC_CHUNK_ANALYSIS_threads4.txt": f"Matrix: m3\nSchedule Type: STATIC - CHUNK SIZE ANALYSIS\nNumber of threads: 4\n\nSEQUENTIAL (baseline - no parallelization):\n9.0\nAverage: 9.0 ms | 90th percentile: 9.0 ms\n\n"
    f"{RULE}\nCHUNK SIZE ANALYSIS\n{RULE}\n\nCHUNK SIZE: 1\n3.5\n2.5\nAverage: 3.0 ms | 90th percentile: 3.5 ms | Speedup: 3.00x\n\nCHUNK SIZE: 20\n1.25\nAverage: 1.25 ms | 90th percentile: 1.25 ms | Speedup: 7.20x\n\n{RULE}\nBEST CHUNK SIZE: 20\nBest Average: 1.25 ms (Speedup: 7.20x)\n",
    "CLUSTER/x/runtime/16_threads/RESULTS_m4_guided_CHUNK_ANALYSIS_threads16.txt": "Matrix: m4\nSchedule: guided\nThreads: 16\n\nSEQUENTIAL baseline avg: 0.5 ms | 90th: 0.7 ms\n\nChunk 1: Avg 0.124 ms | 90th 0.165 ms | Speedup 0.04x\nChunk 50: Avg 0.1 ms | 90th 0.11 ms | Speedup 0.05x\n\nBest chunk size: 50 (Avg 0.1 ms, Speedup 0.05x)\n",
}


def test_result_layouts(spark, tmp_path):
    for name, text in LAYOUTS.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = run_files.runs_scan(spark, str(tmp_path)).collect()
    assert sorted((r.matrix, r.env, r.variant, r.schedule, r.threads or 0, r.chunk or 0, r.section, r.run, r.ms) for r in got) == [
        ("m1", "LOCAL", "parallel", "none", 0, 0, "parallel", 1, 0.3),
        ("m1", "LOCAL", "sequential", "none", 0, 0, "sequential", 1, 0.1), ("m1", "LOCAL", "sequential", "none", 0, 0, "sequential", 2, 0.2),
        ("m2", "CLUSTER", "parallel", "none", 8, 0, "parallel", 1, 0.5), ("m2", "CLUSTER", "parallel", "none", 8, 0, "parallel", 2, 0.75),
        ("m2", "CLUSTER", "sequential", "none", 8, 0, "sequential", 1, 1.5), ("m2", "CLUSTER", "sequential", "none", 8, 0, "sequential", 2, 2.5),
        ("m3", "CLUSTER", "sequential", "static", 4, 0, "sequential", 1, 9.0),
        ("m3", "CLUSTER", "static-1", "static", 4, 1, "chunk", 1, 3.5), ("m3", "CLUSTER", "static-1", "static", 4, 1, "chunk", 2, 2.5), ("m3", "CLUSTER", "static-20", "static", 4, 20, "chunk", 1, 1.25),
    ]
    lines = run_files.summaries_scan(spark, str(tmp_path)).collect()
    assert sorted((r.matrix, r.schedule, r.threads, r.chunk, r.mean, r.p90, r.speedup) for r in lines) == [("m4", "guided", 16, 1, 0.124, 0.165, 0.04), ("m4", "guided", 16, 50, 0.1, 0.11, 0.05)]


def test_written_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda ms, *cells: spark.createDataFrame([("m", s, n, ms) for s, n in cells], "matrix string, schedule string, threads int, ms double")
    run_files.runs_write(rows(1.0, ("static", 4), ("static", 8)), path)
    run_files.runs_write(rows(2.0, ("static", 8), ("auto", 4)), path)
    assert sorted((r.schedule, r.threads, r.ms) for r in spark.read.parquet(path).collect()) == [("auto", 4, 2.0), ("static", 4, 1.0), ("static", 8, 2.0)]
    run_files.runs_write(rows(3.0, ("guided", 4)), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first().ms == 3.0


def test_long_sections_go_over_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_files, "FILE_RUNS", 7)
    runs = spark.range(1, 31).select(F.lit("m").alias("matrix"), F.lit("static").alias("schedule"), F.lit(4).alias("threads"), F.lit(5).alias("chunk"), F.col("id").cast("int").alias("run"), (F.col("id") / 8).alias("ms"))
    run_files.write_chunk_files(runs, str(tmp_path / "t"))
    got = run_files.runs_scan(spark, str(tmp_path / "t")).collect()
    assert sorted((r.run, r.ms) for r in got) == [(k, k / 8) for k in range(1, 31)] and all(math.isfinite(r.ms) for r in got)


def test_size_line_in_a_late_split(spark, tmp_path):
    """A comment block that fills the first splits of a file."""
    lines = ["%%MatrixMarket matrix coordinate real general"] + ["% " + "c" * 998] * 10_000 + ["3 4 2", "1 1 5.0", "3 4 6.0"]
    (tmp_path / "a.mtx").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert sorted(tuple(r)[2:] for r in matrix_market.mm_scan(spark, str(tmp_path)).collect()) == [(0, 0, 5.0), (2, 3, 6.0)]
        assert matrix_market.mm_rejects(spark, str(tmp_path)).count() == 0
        one = matrix_market.mm_catalog(spark, str(tmp_path)).first()
        assert (one.nrows, one.ncols, one.nnz_declared, one.nnz_stored) == (3, 4, 2, 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 1.0\n")
    plan = matrix_market.mm_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "hashpartitioning" not in plan


def test_empty_compressed_matrix(spark, tmp_path):
    none = spark.createDataFrame([], "matrix string, i long, j long, v double")
    rows = spark.createDataFrame([("m", 0), ("m", 1)], "matrix string, i long")
    for k, domain in enumerate((rows, rows.limit(0))):
        csr_tables.csr_write(none, domain, domain.groupBy("matrix").count(), f"{tmp_path}/{k}")
        matrices, ptr, slots = csr_tables.csr_read(spark, f"{tmp_path}/{k}")
        assert (matrices.count(), sorted((r.i, r.n, r.ptr) for r in ptr.collect()), slots.count()) == ((1, [(0, 0, 0), (1, 0, 0)], 0) if k == 0 else (0, [], 0))


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
    assert storage.qualified(spark, "/tmp/x").startswith("file:")


def test_lines_that_are_no_samples(spark, tmp_path):
    text = "Matrix: m\nTimes (ms):\n0.5\n7\n1e-3\nnan\ninf\n-1.5\n1.2.3\n\nAverage: 0.5 ms\n"
    (tmp_path / "RESULTS_m_SEQUENTIAL.txt").write_text(text)
    assert [r.ms for r in run_files.runs_scan(spark, str(tmp_path)).orderBy("run").collect()] == [0.5, 7.0, 0.001]
    assert sorted(r.line for r in run_files.runs_rejects(spark, str(tmp_path)).collect()) == ["-1.5", "1.2.3", "inf", "nan"]


@pytest.mark.parametrize("before, after", [("4096", "1m"), ("1m", "4096")])
def test_entries_do_not_depend_on_splits(spark, tmp_path, before, after):
    """The files are cut otherwise when the rows are read than when the query was built; one has entries equal to its size line, and late comments."""
    lines = ["% " + "c" * 80] * 300 + ["50 50 3000"] + [f"{k % 50 + 1} {k % 7 + 1} {k}" for k in range(2000)] + ["% late", "50 50 3000", "x", "50 50 3000"] + [f"1 2 {k}" for k in range(998)]
    (tmp_path / "a.mtx").write_text(HEAD.format("integer", "general") + "\n".join(lines) + "\n")
    (tmp_path / "b.mtx").write_text(HEAD.format("real", "symmetric") + "2 2 2\n2 2 2\n2 1 5\n")
    size, parts = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, before)
        built = [f(spark, str(tmp_path)) for f in (matrix_market.mm_scan, matrix_market.mm_catalog, matrix_market.mm_rejects)]
        spark.conf.set(size, after)
        spark.conf.set(parts, "1" if after == "1m" else "40")
        entries, catalog, rejects = (df.collect() for df in built)
    finally:
        spark.conf.set(size, old)
        spark.conf.unset(parts)
    expected = [("a", k % 50, k % 7, float(k)) for k in range(2000)] + [("a", 49, 49, 3000.0)] * 2 + [("a", 0, 1, float(k)) for k in range(998)] + [("b", 1, 1, 2.0), ("b", 1, 0, 5.0)]
    assert sorted((r.matrix, r.i, r.j, r.v) for r in entries) == sorted(expected)
    assert sorted((r.matrix, r.nnz_declared, r.nnz_stored, r.nnz_expanded) for r in catalog) == [("a", 3000, 3000, 3000), ("b", 2, 2, 3)]
    assert sorted(tuple(r) for r in rejects) == [("a", matrix_market.BAD_ENTRY, "x"), ("a", matrix_market.LATE_COMMENT, "% late")]


def test_many_entries_equal_to_the_size_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrix_market, "_COPIES", 7)
    (tmp_path / "a.mtx").write_text(HEAD.format("real", "general") + "2 3 4\n" * 101)
    assert [tuple(r)[2:] for r in matrix_market.mm_scan(spark, str(tmp_path)).collect()] == [(1, 2, 4.0)] * 100


def test_row_ranges_are_pushed_down(spark, tmp_path):
    entries = spark.range(6000).select(F.lit("m").alias("matrix"), (F.col("id") % 300).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    sizes = spark.createDataFrame([("m", 300)], "matrix string, nrows long")
    csr_tables.csr_write(entries, layout.row_domain(sizes), sizes, str(tmp_path / "m"))
    part = csr_tables.csr_rows(spark, str(tmp_path / "m"), "m", 100, 102)
    assert sorted((r.i, r.j) for r in part.collect()) == sorted((k % 300, k) for k in range(6000) if 100 <= k % 300 <= 102)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pos,2000)" in plan and "LessThan(pos,2060)" in plan and "PartitionFilters: [isnotnull(matrix" in plan
    assert csr_tables.csr_rows(spark, str(tmp_path / "m"), "m", 900, 950).count() == csr_tables.csr_rows(spark, str(tmp_path / "m"), "none", 0, 5).count() == 0


def test_what_was_written_can_be_cleared(spark):
    df = storage.written(spark.range(3), "kept")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and spark.sparkContext.applicationId in path
    storage.clear(spark)
    assert not os.path.exists(path) and storage.written(spark.range(3), "more").count() == 3


@pytest.mark.parametrize("before, after", [("512", "1m"), ("1m", "512"), ("700", "700")])
def test_result_files_larger_than_a_task(spark, tmp_path, before, after):
    """Sections that begin in one split and go on over many: the same rows however the files are cut, also between building and reading."""
    rows, size = [], "spark.sql.files.maxPartitionBytes"
    for m in ("m1", "m2"):
        text = f"Matrix: {m}\nSchedule Type: STATIC - CHUNK SIZE ANALYSIS\nNumber of threads: 4\n\n"
        for chunk, n in ((None, 3), (1, 700), (5, 1), (10, 0), (20, 1500)):
            text += ("SEQUENTIAL (baseline - no parallelization):" if chunk is None else f"\nCHUNK SIZE: {chunk}") + "\n"
            text += "".join(f"{k}.25\n" + ("-7\n" if k % 500 == 9 else "") for k in range(n)) + "Average: 1 ms | 90th percentile: 2 ms\n"
            rows += [(m, "sequential" if chunk is None else f"static-{chunk}", chunk, k + 1, k + 0.25) for k in range(n)]
        (tmp_path / f"{m}.txt").write_text(text + "\nBEST CHUNK SIZE: 1\n12345\n")
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, before)
        scan, rejects = run_files.runs_scan(spark, str(tmp_path)), run_files.runs_rejects(spark, str(tmp_path))
        spark.conf.set(size, after)
        got = sorted((r.matrix, r.variant, r.chunk or 0, r.run, r.ms) for r in scan.collect())
        assert got == sorted((m, v, c or 0, k, x) for m, v, c, k, x in rows)
        assert sorted((r.matrix, r.chunk, r.line) for r in rejects.collect()) == sorted((m, c, "-7") for m in ("m1", "m2") for c in (1, 1, 20, 20, 20))
    finally:
        spark.conf.set(size, old)


def test_a_table_can_be_discarded_alone(spark, tmp_path):
    one, two = storage.written(spark.range(3), "one"), storage.written(spark.range(4), "two")
    spark.range(2).write.parquet(f"file://{tmp_path}/other")
    other = spark.read.parquet(f"file://{tmp_path}/other")
    paths = [df.inputFiles()[0].removeprefix("file://") for df in (one, two, other)]
    storage.discard(one)
    storage.discard(other)
    assert [os.path.exists(x) for x in paths] == [False, True, True]


def test_reports_share_files(spark, tmp_path):
    """Many matrices are written into few files, in each layout, and read back."""
    runs = spark.range(900).select(
        F.expr("id div 3").cast("string").alias("matrix"), F.lit("static").alias("schedule"), F.lit(4).alias("threads"), F.when(F.col("id") % 3 > 0, 5).alias("chunk"),
        F.when(F.col("id") % 3 > 0, "parallel").otherwise("sequential").alias("section"), F.greatest(F.lit(1), F.col("id") % 3).cast("int").alias("run"), F.col("id").cast("double").alias("ms"),
    )
    for name, write, of in (("chunk", run_files.write_chunk_files, "chunk"), ("plain", run_files.write_plain_files, "parallel"), ("paired", run_files.write_paired_files, "parallel")):
        write(runs, str(tmp_path / name))
        assert len(list((tmp_path / name).rglob("part-*.txt"))) <= 20
        got = run_files.runs_scan(spark, str(tmp_path / name)).collect()
        assert sorted((int(r.matrix), r.section, r.run, r.ms) for r in got) == sorted((k // 3, of if k % 3 else "sequential", max(1, k % 3), float(k)) for k in range(900))
    cells = spark.range(300).select(F.col("id").alias("matrix"), F.lit("guided").alias("schedule"), F.lit(4).alias("threads"), F.lit(1).alias("chunk"), F.col("id").cast("double").alias("mean"), F.lit(1.0).alias("p90"), F.lit(2.0).alias("speedup"))
    run_files.write_summary_files(cells, str(tmp_path / "summary"))
    assert len(list((tmp_path / "summary").rglob("part-*.txt"))) <= 20
    assert sorted((int(r.matrix), r.mean) for r in run_files.summaries_scan(spark, str(tmp_path / "summary")).collect()) == [(k, float(k)) for k in range(300)]


@pytest.mark.parametrize("split", ["40", "100", "1m"])
def test_reports_in_one_file(spark, tmp_path, split, monkeypatch):
    """What names a report may come after its samples; a report ends at the next matrix, also when that has no section; reports and sections go over splits."""
    text = "Threads: 8\nMatrix: a\nTimes (ms):\n" + "".join(f"{k}.5\n" for k in range(40)) + "Schedule: auto\nMatrix: b\n7\n8\nMatrix: c\nThreads: 2\nSEQUENTIAL VERSION:\n1.5\n\nPARALLEL VERSION:\n" + "2.5\n-1\n" * 30
    (tmp_path / "all.txt").write_text(text)
    monkeypatch.setattr(run_files, "BROADCAST_ROWS", 100_000 if split == "100" else 0)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = run_files.runs_scan(spark, str(tmp_path)).collect()
        assert sorted((r.matrix, r.schedule, r.threads, r.section, r.run, r.ms) for r in got) == sorted(
            [("a", "auto", 8, "sequential", k + 1, k + 0.5) for k in range(40)] + [("c", "none", 2, "sequential", 1, 1.5)] + [("c", "none", 2, "parallel", k + 1, 2.5) for k in range(30)]
        )
        assert [(r.matrix, r.threads, r.line) for r in run_files.runs_rejects(spark, str(tmp_path)).collect()] == [("c", 2, "-1")] * 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_files_are_bounded(spark, tmp_path, monkeypatch):
    """Files grow in number with the entries, also where a row or the last block holds most of them, and each has the count of its own entries."""
    monkeypatch.setattr(matrix_market, "FILE_ENTRIES", 100)
    entries = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("i"), F.col("id").alias("j"), F.lit(1.5).alias("v"))
    matrix_market.mm_write(entries, str(tmp_path / "m"), 50, 3000)
    sizes = [(int(x[1].split()[2]), len(x) - 2) for x in ((p.read_text().splitlines()) for p in (tmp_path / "m").glob("part-*")) if x]
    assert all(a == b for a, b in sizes) and sum(a for a, _ in sizes) == 3000 and max(a for a, _ in sizes) <= 200
    got = matrix_market.mm_scan(spark, str(tmp_path), "folder").collect()
    assert sorted((r.i, r.j) for r in got) == sorted((7 if k < 2000 else k % 50, k) for k in range(3000))


def test_headers_are_found_without_a_sort(spark, folder):
    plan = matrix_market._headers(matrix_market._lines(spark, folder, "file"))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_small_matrices_in_a_table(spark, tmp_path):
    """A table of texts gives the same rejects as the files."""
    spark.createDataFrame(list(FILES.items()), "file string, text string").write.parquet(str(tmp_path / "t"))
    (tmp_path / "f").mkdir()
    for name, text in FILES.items():
        (tmp_path / "f" / name).write_text(text)
    rows = lambda df: sorted((r.matrix, r.reason, r.line or "") for r in df.collect())
    assert rows(matrix_market.mm_rejects(spark, str(tmp_path / "t"), form="table")) == rows(matrix_market.mm_rejects(spark, str(tmp_path / "f")))
