import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmesh.llm import sharding as s


def draws(spark, good, total, drawn, n=6000):
    number = lambda x: F.lit(x).cast("long")
    df = spark.range(n).select(s.hypergeometric(number(good), number(total), number(drawn), s._uniform(F.col("id"), F.lit(3))).alias("x"))
    return np.array([r.x for r in df.collect()])


@pytest.mark.parametrize("good, total, drawn", [(5, 20, 8), (1, 2, 1), (90, 100, 50), (400, 5000, 2500), (12_500_000, 100_000_000, 50_000_000)])
def test_draws_follow_the_law(spark, good, total, drawn):
    found = draws(spark, good, total, drawn)
    mean, variance = drawn * good / total, drawn * good / total * (total - good) / total * (total - drawn) / (total - 1)
    assert found.min() >= max(0, drawn - (total - good)) and found.max() <= min(good, drawn)
    assert abs(found.mean() - mean) < 5 * (variance / len(found)) ** 0.5 and abs(found.var() / variance - 1) < 0.12
    if total <= 100:
        from math import comb

        for k, n in Counter(found.tolist()).items():
            p = comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn)
            assert abs(n - len(found) * p) < 5 * (len(found) * p * (1 - p)) ** 0.5 + 2


@pytest.mark.parametrize("good, total, drawn, only", [(0, 5, 3, 0), (5, 5, 3, 3), (2, 5, 0, 0), (2, 5, 5, 2), (0, 0, 0, 0)])
def test_certain_draws(spark, good, total, drawn, only):
    assert set(draws(spark, good, total, drawn, 20).tolist()) == {only}


@pytest.mark.parametrize("blocks", [1, 2, 3, 17])
def test_matrix_has_the_block_and_shard_sizes(spark, blocks):
    sizes = [(b * 10, 1 + b * 7 % 50) for b in range(blocks)]
    total = sum(n for _, n in sizes)
    df = spark.createDataFrame(sizes, "block long, n long")
    matrix = {r.block: r.sent for r in s.communication_matrix(df, s.shard_sizes(total, 5), blocks, 1).collect()}
    assert {b: sum(row) for b, row in matrix.items()} == dict(sizes)
    assert [sum(row[k] for row in matrix.values()) for k in range(5)] == s.shard_sizes(total, 5)


@pytest.mark.parametrize("n, parts, bits", [(1000, 3, 16), (1003, 7, 5), (5, 2, 16), (1, 1, 16)])
def test_shards_are_exact_and_slots_gapless(spark, n, parts, bits):
    df = spark.range(n).select(F.lit(7).alias("doc_id"), F.col("id").alias("slot"), F.lit("clash").alias("Shard"), F.col("id").alias("keep")).repartition(parts)
    rows = s.shuffle_into_shards(df, 8, 3, bits).collect()
    assert sorted(r.keep for r in rows) == list(range(n))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_places_are_uniform(spark):
    """Over many seeds each row comes to each shard, and to either half of its slots, equally often; neighbours part as by chance."""
    df = spark.range(64).repartition(2).cache()
    where, together, seeds = Counter(), 0, 6
    for seed in range(seeds):
        place = {r.id: (r.shard, r.slot) for r in s.shuffle_into_shards(df, 8, seed, 3).collect()}
        where.update(place[i] for i in range(64))
        together += sum(place[i][0] == place[i + 1][0] for i in range(63))
    assert all(n == seeds for n in where.values()) and len(where) == 64
    expected = 63 * seeds * 7 / 63
    assert abs(together - expected) < 5 * expected**0.5


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "a", None), (None, None, "x"), (1, "a", None)], "doc_id long, text string, law string")
    out = s.sharded_documents(df)
    out.explain()
    assert "Python" not in capsys.readouterr().out
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32, r.law, r.grown_shard) for r in out.collect()) == [(0, 1, 0, "rows", None)] + 2 * [(1, 2, zlib.crc32(b"a"), "rows", None)]
    assert s.sharded_documents(df.limit(0)).count() == 0 and s.sharded_documents(df.limit(0)).columns == out.columns


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_matrix_dealt_over_several_levels(spark, fan):
    sizes = [(b * 3, b * 11 % 40) for b in range(23)]
    total = sum(n for _, n in sizes)
    df = spark.createDataFrame(sizes, "block long, n long")
    matrix = {r.block: r.sent for r in s.communication_matrix(df, s.shard_sizes(total, 4), len(sizes), 5, fan).collect()}
    assert {b: sum(row) for b, row in matrix.items()} == dict(sizes)
    assert [sum(row[k] for row in matrix.values()) for k in range(4)] == s.shard_sizes(total, 4)
