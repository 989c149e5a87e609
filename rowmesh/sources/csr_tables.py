"""Row-compressed matrices as tables: the three parts of the compressed form, partitioned by matrix and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.operators.layout import csr_slots, row_ptr


_SCHEMAS = {"row_ptr": "i long, n long, ptr long, matrix string", "slots": "i long, j long, v double, pos long, matrix string"}


def csr_write(entries: DataFrame, rows: DataFrame, matrices: DataFrame, path: str) -> None:
    """matrices, row_ptr(i, ptr, n) and slots(pos, i, j, v) under a folder, sorted by range so that readers can skip row groups.

    A matrix without entries has its row pointers and no slots; no matrices at all give empty tables.
    """
    matrices.write.mode("overwrite").parquet(f"{path}/matrices")
    for name, table, key in (("row_ptr", row_ptr(entries, rows).repartitionByRange("matrix", "i"), "i"), ("slots", csr_slots(entries), "pos")):
        # Slots lie in ranges already, as they were ranked by them.
        table = table.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _SCHEMAS[name].split(", ")])
        table.sortWithinPartitions("matrix", key).write.partitionBy("matrix").mode("overwrite").parquet(f"{path}/{name}")


def csr_read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """matrices, row_ptr and slots of csr_write()."""
    parts = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS.items())
    return (spark.read.parquet(f"{path}/matrices"), *parts)


def csr_rows(spark: SparkSession, path: str, matrix: str, first: int, last: int) -> DataFrame:
    """(pos, i, j, v) of rows first to last of one matrix: the row pointers turn them into a range of places, by which Parquet skips what lies outside. No such rows give none."""
    _, pointers, slots = csr_read(spark, path)
    mine = pointers.where((F.col("matrix") == matrix) & F.col("i").between(first, last))
    begin, end = mine.agg(F.min("ptr"), F.max(F.col("ptr") + F.col("n"))).first()
    return slots.where((F.col("matrix") == matrix) & (F.col("pos") >= (begin or 0)) & (F.col("pos") < (end or 0))).select("pos", "i", "j", "v")
