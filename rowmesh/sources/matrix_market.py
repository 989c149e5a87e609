"""Coordinate matrix text (Matrix Market): many files, split files, bad lines kept as data.

A line is read by itself, so large files are read in splits. The size line of a file
is its first line that is no comment, in whichever split. One read finds it, a second
counts how often its text comes again; after that no line's place matters: every line
that is no comment and differs from the size line is an entry, and of those equal to it
all but one are. So the entries are the same however later reads cut the files. Lines
meet the headers, one row per file, without a shuffle. Comments after the size line do
have a place; mm_rejects() takes them from one read that is written.

Many small matrices may also come as a Parquet table (file, text), a row for each file
with all of its text (form="table"), so that they don't need a file each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmesh.functions.storage import written
from rowmesh.operators.layout import sym_expand

#: Headers that every task holds, at most; more files than this are joined as Spark sees fit.
BROADCAST_FILES = 100_000
#: Entries that mm_write() puts into one file, as nearly as rows and places allow.
FILE_ENTRIES = 1_000_000
#: Entries equal to their file's size line that one row makes.
_COPIES = 1 << 16

#: Reasons in mm_rejects().
NO_SIZE, BAD_SIZE, UNSUPPORTED, LATE_COMMENT, BAD_ENTRY, OUT_OF_RANGE = "missing size line", "bad size line", "unsupported matrix", "comment after size line", "bad entry", "index out of range"


def _name(path: Column, by: str) -> Column:
    """A matrix is named by its file, without what follows the first dot, or by its folder."""
    parts = F.split(path, "/")
    return F.substring_index(F.element_at(parts, -1), ".", 1) if by == "file" else F.element_at(parts, -2)


def _lines(spark: SparkSession, path: str, by: str, form: str = "text") -> DataFrame:
    if form == "table":
        lines = spark.read.parquet(path).select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_id", "value"))
        return lines.select("file", _name(F.col("file"), by).alias("matrix"), F.lit(0).cast("long").alias("at"), F.col("line_id").cast("long").alias("line_id"), F.trim("value").alias("line"))
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), _name(F.col("_metadata.file_path"), by).alias("matrix"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line_id"), F.trim("value").alias("line"),
    )


def _headers(lines: DataFrame) -> DataFrame:
    """One row per file with lines: field, symmetry, the size line and its numbers (null where there are none)."""
    # Titles count in a file's first split only. A list of them, as against their least, makes Spark aggregate by hash, where it would sort all lines of a task.
    title = F.startswith("line", F.lit("%%MatrixMarket")) & (F.col("at") == 0)
    found = lines.where("line != ''").groupBy("file").agg(
        F.first("matrix").alias("matrix"),
        F.array_min(F.collect_list(F.when(title, F.struct("line_id", "line"))))["line"].alias("head"),
        F.min(F.when(~F.startswith("line", F.lit("%")), F.struct("at", "line_id", "line"))).alias("size"),
    )
    words, numbers = F.split(F.lower("head"), r"\s+"), F.split(F.col("size.line"), r"\s+")
    number = lambda k: F.when(F.size(numbers) == 3, F.get(numbers, F.lit(k)).try_cast("long"))
    return found.select(
        "file", "matrix", F.coalesce(F.get(words, F.lit(3)), F.lit("real")).alias("field"), F.coalesce(F.get(words, F.lit(4)), F.lit("general")).alias("symmetry"),
        F.col("size.line").alias("size_line"), number(0).alias("nrows"), number(1).alias("ncols"), number(2).alias("nnz_declared"),
    )


def _sized() -> Column:
    return F.col("nrows").isNotNull() & F.col("ncols").isNotNull() & F.col("nnz_declared").isNotNull()


def mm_headers(spark: SparkSession, path: str, by: str = "file", form: str = "text") -> DataFrame:
    """(file, matrix, field, symmetry, size_line, nrows, ncols, nnz_declared) of every file with lines, as a table that mm_entries() takes, so that they are read once."""
    return written(_headers(_lines(spark, path, by, form)), "headers")


def _parsed(spark: SparkSession, path: str, by: str, form: str = "text", headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers, and every line that is neither a comment nor the size line with its entry or the reason why it has none."""
    lines = _lines(spark, path, by, form)
    headers = headers or mm_headers(spark, path, by, form)
    few = headers.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    known = F.broadcast(headers.drop("matrix")) if few else headers.drop("matrix")
    plain = lines.select("file", "matrix", "line").where("line != '' and not startswith(line, '%')").join(known, "file")
    # Lines equal to the size line, but for itself: a row for each stretch of them.
    again = plain.where("line = size_line").groupBy("file").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    again = written(again.select("file", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(_COPIES).cast("long"))).alias("first"), "n"), "again")
    copies = again.select("file", F.explode(F.sequence("first", F.least("n", F.col("first") + (_COPIES - 1))))).select("file").join(F.broadcast(headers) if few else headers, "file")
    body = plain.where("line != size_line").unionByName(copies.withColumn("line", F.col("size_line")))
    # Words are split once, by a generator, as filters on what is made of them would split again; and by a blank, which is faster, where nothing else stands between them.
    odd = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        odd |= F.contains("line", F.lit(blank))
    body = body.select("*", F.explode(F.array(F.when(odd, F.split("line", r"\s+")).otherwise(F.split("line", " ")))).alias("words"))
    word = lambda k: F.get("words", F.lit(k))
    pattern = F.col("field") == "pattern"
    body = body.withColumns(
        {
            "i": word(0).try_cast("long") - 1,
            "j": word(1).try_cast("long") - 1,
            "v": F.when(pattern, F.lit(1.0)).otherwise(word(2).try_cast("double")),
            "whole": F.size("words") == F.when(pattern, 2).otherwise(3),
        }
    ).drop("words")
    reason = (
        F.when(~_sized(), F.lit(BAD_SIZE))
        .when((F.col("field") == "complex") | (F.col("symmetry") == "hermitian"), UNSUPPORTED)
        .when(~F.col("whole") | F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull(), BAD_ENTRY)
        .when(~F.col("i").between(0, F.col("nrows") - 1) | ~F.col("j").between(0, F.col("ncols") - 1), OUT_OF_RANGE)
    )
    return headers, body.withColumn("reason", reason)


def _late_comments(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(matrix, line): comments after the size line of files that have a good one. Places are those of one read, which is written."""
    sizes = headers.where(_sized() & (F.col("field") != "complex") & (F.col("symmetry") != "hermitian")).select("file", "size_line")
    comment = F.startswith("line", F.lit("%"))
    marks = lines.join(sizes, "file").where(comment | (F.col("line") == F.col("size_line"))).select("file", "matrix", F.struct("at", "line_id").alias("place"), F.when(comment, F.col("line")).alias("line"))
    marks = written(marks, "marks")
    sized = marks.where("line is null").groupBy("file").agg(F.min("place").alias("after"))
    return marks.where("line is not null").join(sized, "file").where("place > after").select("matrix", "line")


def mm_scan(spark: SparkSession, path: str, by: str = "file", headers: DataFrame | None = None) -> DataFrame:
    """(matrix, symmetry, i, j, v): the stored entries, 0-based; pattern entries count 1.0. Mirrors are left to sym_expand()."""
    return _parsed(spark, path, by, headers=headers)[1].where("reason is null").select("matrix", "symmetry", "i", "j", "v")


def mm_catalog(spark: SparkSession, path: str, by: str = "file") -> DataFrame:
    """One row per matrix: field, symmetry, nrows, ncols, entries declared, stored and after expansion."""
    headers, body = _parsed(spark, path, by)
    heads = headers.groupBy("matrix").agg(
        F.min("field").alias("field"), F.min("symmetry").alias("symmetry"), F.max("nrows").alias("nrows"), F.max("ncols").alias("ncols"), F.sum("nnz_declared").alias("nnz_declared")
    )
    good = body.where("reason is null")
    twice = F.col("symmetry").isin("symmetric", "skew-symmetric") & (F.col("i") != F.col("j"))
    counts = good.groupBy("matrix").agg(F.count(F.lit(1)).alias("nnz_stored"), F.sum(twice.cast("long")).alias("more"))
    zero = F.lit(0).cast("long")
    return heads.join(counts, "matrix", "left").select(
        "matrix", "field", "symmetry", "nrows", "ncols", "nnz_declared", F.coalesce("nnz_stored", zero).alias("nnz_stored"),
        (F.coalesce("nnz_stored", zero) + F.coalesce("more", zero)).alias("nnz_expanded"),
    )


def mm_rejects(spark: SparkSession, path: str, by: str = "file", form: str = "text") -> DataFrame:
    """(matrix, reason, line): lines that give no entry, bad size lines, and files without one (line null)."""
    headers, body = _parsed(spark, path, by, form)
    sizes = headers.where("size_line is not null").where(~_sized()).select("matrix", F.lit(BAD_SIZE).alias("reason"), F.col("size_line").alias("line"))
    lines = body.where("reason is not null").where(F.col("reason") != BAD_SIZE).select("matrix", "reason", "line")
    late = _late_comments(_lines(spark, path, by, form), headers).select("matrix", F.lit(LATE_COMMENT).alias("reason"), "line")
    # The driver's listing, as scans leave out files of no length. Paths are compared without their schemes, which are written differently.
    if form == "table":
        files = spark.read.parquet(path).select("file")
    else:
        listed = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
        files = spark.createDataFrame([(f,) for f in listed], "file string")
    files = files.select(F.regexp_replace("file", r"^\w+:/+", "/").alias("file"))
    sized = headers.where("size_line is not null").select(F.regexp_replace("file", r"^\w+:/+", "/").alias("file"))
    missing = files.join(sized, "file", "left_anti").select(_name(F.col("file"), by).alias("matrix"), F.lit(NO_SIZE).alias("reason"), F.lit(None).cast("string").alias("line"))
    return lines.unionByName(sizes).unionByName(late).unionByName(missing)


def mm_write(entries: DataFrame, path: str, nrows: int, ncols: int, symmetry: str = "general", files: int | None = None) -> None:
    """entries(i, j, v or line) as a folder of coordinate files, each a block of rows, or a part of one, under a header of its own.

    There are as many blocks as FILE_ENTRIES asks for; one that has more entries than
    that, as heavy rows make it, is dealt to several files. A column `line` may hold the
    text of an entry in place of (i, j, v).
    """
    files = files or max(entries.sparkSession.sparkContext.defaultParallelism, -(-entries.count() // FILE_ENTRIES))
    text = F.col("line") if "line" in entries.columns else F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string"))
    rows = F.least(F.lit(files - 1), F.greatest(F.lit(0), F.floor(F.col("i") * files / nrows))).cast("int")
    sizes = written(entries.groupBy(rows.alias("rows")).agg(F.ceil(F.count(F.lit(1)) / FILE_ENTRIES).alias("pieces")), "sizes")
    # One row per block.
    first = F.coalesce(F.sum("pieces").over(Window.orderBy("rows").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = int(sizes.agg(F.sum("pieces")).first()[0] or 1)
    dealt = entries.withColumn("rows", rows).join(F.broadcast(sizes.select("rows", "pieces", first.alias("first"))), "rows")
    block = (F.col("first") + F.pmod(F.xxhash64("i", "j", text), F.col("pieces"))).cast("int")
    body = dealt.select(block.alias("block"), F.lit(2).alias("part"), text.alias("value"))
    counts = body.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select(
        "block",
        F.inline(F.array(
            F.struct(F.lit(0).alias("part"), F.lit(f"%%MatrixMarket matrix coordinate real {symmetry}").alias("value")),
            F.struct(F.lit(1).alias("part"), F.concat_ws(" ", F.lit(str(nrows)), F.lit(str(ncols)), F.col("n").cast("string")).alias("value")),
        )),
    )
    body.unionByName(head).repartitionById(files, "block").sortWithinPartitions("part").select("value").write.text(path)


def mm_entries(spark: SparkSession, path: str, by: str = "file", headers: DataFrame | None = None) -> DataFrame:
    """(matrix, i, j, v) with symmetric storage expanded; headers of mm_headers() are not read again."""
    return sym_expand(mm_scan(spark, path, by, headers), F.col("symmetry")).select("matrix", "i", "j", "v")
