"""Result files of benchmark runs: a reader for the four text layouts, writers of them, and partitioned tables.

A file holds one report or several, one after the other; each but the first begins
with the line that names its matrix. So there need not be a file for each matrix, and
the writers make as many files as there are tasks.

Files are read line by line, in as many splits as they have. A line's section is named
by the last title before it in its report: titles are filled in and reports counted
within each split, where lines lie in order, and a carry table of one row per split says
which section goes on at its start, how many samples that has had and how many reports
there were. So a result file may be larger than a task, and no text is gathered into one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmesh.functions.ranking import same_as_before
from rowmesh.functions.storage import written

# The titles by which a section of a result file is known, and the lines that name what a file is about.
SEQUENTIAL, PARALLEL, CHUNK, TIMES, CHUNK_LINE, SUMMARY = "SEQUENTIAL", "PARALLEL", "CHUNK SIZE: ", "Times (ms):", "Chunk ", "SUMMARY:"
VERSION, BASELINE_TITLE = " VERSION:", "SEQUENTIAL (baseline - no parallelization):"
TITLE = rf"^(?:{SEQUENTIAL}|{PARALLEL}{VERSION[:-1]}|{CHUNK}|{CHUNK_LINE}|{SUMMARY}|BEST|Best chunk|Times)"
MATRIX, SCHEDULE_TYPE, SCHEDULE, N_THREADS, THREADS, PART = "Matrix: ", "Schedule Type: ", "Schedule: ", "Number of threads: ", "Threads: ", "Part: "
MATRIX_LINE, SCHEDULE_LINE, THREADS_LINE, PART_LINE = r"^Matrix: (\S+)", r"^Schedule(?: Type)?: (\w+)", r"^(?:Number of threads|Threads): (\d+)", r"^Part: (\d+)"
SUMMARY_LINE = f"{CHUNK_LINE}%d: Avg %.6f ms | 90th %.6f ms | Speedup %.2fx"
SAMPLE_FORMAT = "%.6f"
#: A line that is a sample, and one that looks like a number but is none.
SAMPLE = r"[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]{1,3})?"
NUMERIC = r"[-+]?(?:[0-9][0-9.eE+-]*|\.[0-9.eE+-]+|[iI]nf(?:inity)?|INF|[nN]a[nN]|NAN)"
#: Samples of a section that one report of a writer holds.
FILE_RUNS = 1000
#: Reports, or splits that begin within a report, that every task holds a row for, at most; more are joined.
BROADCAST_ROWS = 100_000


def _part(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def runs_scan(spark: SparkSession, path: str) -> DataFrame:
    """(env, matrix, variant, schedule, threads, chunk, section, run, ms, part) from the files under a folder.

    Files with samples give a row for each; summaries without samples give none
    (see summaries_scan()), nor do lines that are no number (see runs_rejects()). env
    comes from the path, threads and part from the text where the path has none; part
    numbers the pieces of a split result. No files give no rows.
    """
    run = F.col("before") + 1 + F.col("part") * FILE_RUNS
    return _lines(spark, path).where("sample").select("env", "matrix", "variant", "schedule", "threads", "chunk", "section", run.alias("run"), F.col("number").cast("double").alias("ms"), "part")


def runs_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(env, matrix, schedule, threads, chunk, section, line): lines of the sections that look like a number but are no sample: negative, infinite, not a number."""
    found = _lines(spark, path).where("not sample and number is not null and section <> 'summary'")
    return found.select("env", "matrix", "schedule", "threads", "chunk", "section", F.col("number").alias("line"))


def summaries_scan(spark: SparkSession, path: str) -> DataFrame:
    """(env, matrix, schedule, threads, chunk, mean, p90, speedup) from files that hold only a line for each chunk."""
    number = lambda word: _part(F.col("title"), rf"{word} ([0-9.]+)").cast("double")
    found = _lines(spark, path).where("section = 'summary' and number is null")
    return found.select("env", "matrix", "schedule", "threads", "chunk", number("Avg").alias("mean"), number("90th").alias("p90"), number("Speedup").alias("speedup"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, title, number, sample, matrix, ...) in order within each split: with the last title of the split so far in place of the line's own, the samples since then, the line's place, and the lines naming a matrix up to this one and up to the title."""
    last, title, count, place, reports, titled = None, pa.scalar(None, pa.string()), 0, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, at, titles, number, sample, matrix = batch.columns[:6]
        fresh = np.ones(n, bool)
        fresh[1:] = ~(same_as_before(file) & same_as_before(at))
        if last is not None:
            fresh[0] = not all(same_as_before(pa.concat_arrays([last.column(k), batch.column(k)[:1]]))[0] for k in (0, 1))
        begins = fresh | titles.is_valid().to_numpy(zero_copy_only=False)
        begin = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        counts = np.r_[0, np.cumsum(sample.to_numpy(zero_copy_only=False).astype(np.int64))]
        # Rows before the batch's first title go on with what was before.
        before = counts[:-1] - np.where(begin < 0, -count, counts[np.maximum(begin, 0)])
        held = pc.if_else(pa.array(begin < 0), title, titles.take(pa.array(np.maximum(begin, 0))))
        named = np.r_[0, np.cumsum(matrix.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))]
        split = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        report = named[1:] - np.where(split < 0, -reports, named[np.maximum(split, 0)])
        title_report = np.where(begin < 0, titled, report[np.maximum(begin, 0)])
        more = {"before": before, "place": np.arange(place, place + n), "report": report, "title_report": title_report}
        yield pa.RecordBatch.from_arrays([file, at, held, *batch.columns[3:], *map(pa.array, more.values())], [*batch.schema.names, *more])
        last, title, count, place = batch.slice(n - 1), held[n - 1], int(before[-1]) + int(counts[-1] - counts[-2]), place + n
        reports, titled = int(report[-1]), int(title_report[-1])


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Titles, samples and other numbers of all files, each with its section and what its file says."""
    read = spark.read.option("recursiveFileLookup", True).text(path)
    text = F.regexp_replace("value", r"[ \t\r]+$", "")
    number = _part(text, rf"^[ \t\r]*({NUMERIC})$")
    kinds = {"matrix": MATRIX_LINE, "schedule": SCHEDULE_LINE, "threads": THREADS_LINE, "piece": PART_LINE}
    lines = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.when(F.rlike("value", F.lit(TITLE)), text).alias("title"), number.alias("number"),
        F.coalesce(F.rlike(number, F.lit(f"^{SAMPLE}$")), F.lit(False)).alias("sample"), *[_part(F.col("value"), p).alias(k) for k, p in kinds.items()],
    )
    names = " or ".join(f"{k} is not null" for k in kinds)
    marks = lines.where(f"title is not null or number is not null or {names}")
    schema = "file string, at long, title string, number string, sample boolean, " + ", ".join(f"{k} string" for k in kinds) + ", before long, place long, report long, title_report long"
    marks = written(marks.mapInArrow(_filled, schema), "lines")
    carries = _few(written(_carries(marks), "carries"))
    none, inside = F.lit(0), F.col("title").isNotNull()
    going = marks.join(carries, ["file", "at"], "left").withColumns(
        {
            "before": F.col("before") + F.when(inside, none).otherwise(F.coalesce("had", none)),
            "title": F.coalesce("title", "goes_on"),
            # What stands before the first matrix of a file belongs to its first report.
            "report": F.greatest(F.lit(1), F.col("report") + F.coalesce("reports_before", none)),
            "title_report": F.greatest(F.lit(1), F.when(inside, F.col("title_report") + F.coalesce("reports_before", none)).otherwise(F.col("goes_on_report"))),
        }
    )
    # What a report is about: its first such lines, wherever they are.
    place = F.struct("at", "place")
    about = going.where(names).groupBy("file", "report").agg(*[F.min_by(F.col(k), F.when(F.col(k).isNotNull(), place)).alias(k) for k in kinds])
    about = written(about, "reports")
    going = going.where(f"report = title_report and not ({names})").select("file", "report", "title", "number", "sample", "before")
    head = F.col("title")
    alone = F.when(F.contains("file", F.lit("PARALLEL")), "parallel").otherwise("sequential")
    kind = (
        F.when(F.startswith(head, F.lit(CHUNK)), "chunk")
        .when(F.startswith(head, F.lit(PARALLEL)), "parallel")
        .when(F.startswith(head, F.lit(SEQUENTIAL)), "sequential")
        .when(F.startswith(head, F.lit(TIMES)), alone)
        .when(F.startswith(head, F.lit(CHUNK_LINE)), "summary")
    )
    named = going.withColumn("section", kind).where("section is not null").join(_few(about), ["file", "report"], "left")
    return named.select(
        F.when(F.contains("file", F.lit("/LOCAL/")), "LOCAL").when(F.contains("file", F.lit("/CLUSTER/")), "CLUSTER").alias("env"), "matrix",
        F.lower(F.coalesce("schedule", F.lit("none"))).alias("schedule"),
        F.coalesce(_part(F.col("file"), r"/(\d+)_threads/"), _part(F.col("file"), r"threads=(\d+)"), F.col("threads")).cast("int").alias("threads"),
        F.coalesce(_part(F.col("file"), r"/part=(\d+)/").cast("int"), F.col("piece").cast("int"), F.lit(0)).alias("part"),
        "section", "title", "number", "sample", "before", _part(head, r"^(?:CHUNK SIZE: |Chunk )(\d+)").cast("int").alias("chunk"),
    ).withColumn("variant", F.when(F.col("section").isin("chunk", "summary"), F.concat_ws("-", "schedule", F.coalesce(F.col("chunk").cast("string"), F.lit("0")))).otherwise(F.col("section")))


def _carries(marks: DataFrame) -> DataFrame:
    """(file, at, goes_on, had, goes_on_report, reports_before): for each split after a title or a matrix of its file, the last such title, the samples since then, its report, and the matrices named."""
    ends = marks.groupBy("file", "at").agg(
        F.max_by("title", "place").alias("own"), F.max_by(F.col("before") + F.col("sample").cast("long"), "place").alias("n"), F.max_by("title_report", "place").alias("own_report"), F.max("report").alias("reports")
    )
    in_order = Window.partitionBy("file").orderBy("at")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"goes_on": F.last("own", ignorenulls=True).over(earlier), "stretch": F.count("own").over(in_order), "reports_before": F.coalesce(F.sum("reports").over(earlier), F.lit(0))})
    ends = ends.withColumn("out", F.sum("n").over(Window.partitionBy("file", "stretch").orderBy("at")))
    ends = ends.withColumn("goes_on_report", F.last(F.when(F.col("own").isNotNull(), F.col("own_report") + F.col("reports_before")), ignorenulls=True).over(earlier))
    return ends.withColumn("had", F.lag("out").over(in_order)).where("goes_on is not null or reports_before > 0").select("file", "at", "goes_on", "had", "goes_on_report", "reports_before")


def runs_write(runs: DataFrame, path: str, form: str = "parquet") -> None:
    """runs as a table by schedule and threads; partitions that come again replace those before, others stay."""
    runs.write.partitionBy("schedule", "threads").mode("overwrite").option("partitionOverwriteMode", "dynamic").format(form).save(path)


def write_chunk_files(runs: DataFrame, path: str) -> None:
    """runs(matrix, schedule, threads, chunk, run, ms) in the chunk layout, chunk null for the baseline; a report holds at most FILE_RUNS runs of a section, a file any number of reports."""
    keys = ["threads", "matrix", "schedule", "part"]
    pieces = runs.withColumn("part", F.floor((F.col("run") - 1) / FILE_RUNS).cast("int"))
    sections = pieces.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("run", "ms"))).alias("samples"))
    lines = F.array_join(F.transform("samples", lambda s: F.format_string(SAMPLE_FORMAT, s["ms"])), "\n")
    title = F.when(F.col("chunk").isNull(), BASELINE_TITLE).otherwise(F.concat(F.lit(CHUNK), F.col("chunk").cast("string")))
    texts = sections.select(*keys, F.coalesce("chunk", F.lit(-1)).alias("chunk"), F.concat_ws("\n", title, lines, F.lit("")).alias("body"))
    whole = texts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "body"))), lambda s: s["body"]), "\n").alias("bodies"))
    head = F.concat(F.lit(MATRIX), F.col("matrix").cast("string"), F.lit(f"\n{SCHEDULE_TYPE}"), F.upper("schedule"), F.lit(f"\n{N_THREADS}"), F.col("threads").cast("string"), F.lit(f"\n{PART}"), F.col("part").cast("string"), F.lit("\n"))
    whole.select(F.concat_ws("\n", head, "bodies").alias("value")).write.text(path)


def _samples_text() -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "ms"))), lambda s: F.format_string(SAMPLE_FORMAT, s["ms"])), "\n")


def write_plain_files(runs: DataFrame, path: str) -> None:
    """runs(matrix, section, run, ms) in the plain layout: files of one section, 'sequential' or 'parallel'; a report holds at most FILE_RUNS runs, a file any number of reports."""
    pieces = runs.withColumns({"part": F.floor((F.col("run") - 1) / FILE_RUNS).cast("int"), "kind": F.upper("section")})
    texts = pieces.groupBy("kind", "matrix", "part").agg(_samples_text().alias("samples"))
    value = F.concat(F.lit(MATRIX), F.col("matrix").cast("string"), F.lit(f"\n{PART}"), F.col("part").cast("string"), F.lit(f"\n{TIMES}\n"), F.col("samples"), F.lit("\n"))
    texts.select("kind", value.alias("value")).write.partitionBy("kind").text(path)


def write_paired_files(runs: DataFrame, path: str) -> None:
    """runs(matrix, threads, section, run, ms) in the layout of sequential and parallel runs in one report; one holds at most FILE_RUNS runs of each, a file any number of reports."""
    pieces = runs.withColumn("part", F.floor((F.col("run") - 1) / FILE_RUNS).cast("int"))
    sections = pieces.groupBy("threads", "matrix", "part", "section").agg(_samples_text().alias("samples"))
    title = F.when(F.col("section") == "sequential", f"{SEQUENTIAL}{VERSION}").otherwise(f"{PARALLEL}{VERSION}")
    bodies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("section") != "sequential").alias("second"), F.concat_ws("\n", title, "samples").alias("body")))), lambda s: s["body"]), "\n\n")
    files = sections.groupBy("threads", "matrix", "part").agg(bodies.alias("bodies"))
    value = F.concat(F.lit(MATRIX), F.col("matrix").cast("string"), F.lit(f"\n{PART}"), F.col("part").cast("string"), F.lit("\n\n"), F.col("bodies"), F.lit(f"\n\n{SUMMARY}\n"))
    files.select("threads", value.alias("value")).write.partitionBy("threads").text(path)


def write_summary_files(lines: DataFrame, path: str) -> None:
    """lines(matrix, schedule, threads, chunk, mean, p90, speedup) in the layout without samples; the chunks of a matrix are few, a file holds any number of reports."""
    line = F.format_string(SUMMARY_LINE, "chunk", "mean", "p90", "speedup")
    files = lines.groupBy("threads", "matrix", "schedule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    value = F.concat(F.lit(MATRIX), F.col("matrix").cast("string"), F.lit(f"\n{SCHEDULE}"), F.col("schedule"), F.lit(f"\n{THREADS}"), F.col("threads").cast("string"), F.lit("\n\n"), F.col("lines"), F.lit("\n"))
    files.select(value.alias("value")).write.text(path)
