"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in blocks (runs of an input partition). How many rows each block sends
to each shard is drawn first: the matrix has the block sizes as row sums and the
shard sizes as column sums, with the probability that a uniform shuffle of all
rows would give it. Then each block is permuted locally, its rows go to their
shards by rank, and each shard is permuted again. Everything is a DataFrame
expression; the driver sees two numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A block holds at most 2**BLOCK_BITS rows, and a bucket of the second permutation about as many.
BLOCK_BITS = 16
#: Block counts that lie in one row of the communication matrix while it is dealt.
FAN = 1024


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _walk(start: Column, end: Column, ratio, limit: Column | None) -> Column:
    """Weights from start to end, each the one before times ratio(k): (sum, how many partial sums are <= limit)."""
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))

    def step(acc, k):
        w = acc["w"] * ratio(k.cast("double"))
        return _let(
            F.struct(w.alias("w"), (acc["s"] + w).alias("s")),
            lambda t: F.struct(
                t["w"].alias("w"),
                t["s"].alias("s"),
                (acc["n"] + (F.lit(0).cast("long") if limit is None else F.when(t["s"] <= limit, 1).otherwise(0).cast("long"))).alias("n"),
            ),
        )

    return F.aggregate(F.sequence(start, end), zero, step)


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows, taken from `total` without replacement, are among the `good` ones; u in [0, 1) picks it.

    Inverts the distribution from its mode outwards with the exact ratios of
    neighbouring probabilities. What lies beyond 12 standard deviations and 30
    more is less than the step of u.
    """
    zero = F.lit(0).cast("long")
    lo, hi = F.greatest(zero, drawn - (total - good)), F.least(drawn, good)
    g, t, d = good.cast("double"), total.cast("double"), drawn.cast("double")
    mode = F.least(hi, F.greatest(lo, F.floor((d + 1) * (g + 1) / (t + 2)).cast("long")))
    reach = F.ceil(12 * F.sqrt(d * (g / t) * ((t - g) / t) * ((t - d) / F.greatest(t - 1, F.lit(1.0)))) + 30).cast("long")
    up = lambda k: (g - k + 1) * (d - k + 1) / (k * (t - g - d + k))
    down = lambda k: (k + 1) * (t - g - d + k + 1) / ((g - k) * (d - k))

    def arms(m):
        top, bottom = F.least(hi, m["mode"] + m["reach"]), F.greatest(lo, m["mode"] - m["reach"])

        def rise(limit):
            return F.when(top > m["mode"], _walk(m["mode"] + 1, top, up, limit)).otherwise(F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), zero.alias("n")))

        def fall(limit):
            return F.when(bottom < m["mode"], _walk(m["mode"] - 1, bottom, down, limit)).otherwise(F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), zero.alias("n")))

        def pick(s):
            aim = u * (1 + s["rise"] + s["fall"])
            return (
                F.when(aim < 1, m["mode"])
                .when(aim - 1 < s["rise"], F.least(top, m["mode"] + 1 + rise(aim - 1)["n"]))
                .otherwise(F.greatest(bottom, m["mode"] - 1 - fall(aim - 1 - s["rise"])["n"]))
            )

        return _let(F.struct(rise(None)["s"].alias("rise"), fall(None)["s"].alias("fall")), pick)

    return F.when(lo >= hi, lo).otherwise(_let(F.struct(mode.alias("mode"), reach.alias("reach")), arms))


def _split(caps: Column, drawn: Column, shards: int, *keys: Column) -> Column:
    """Of shards with room caps, how much `drawn` rows take of each: a multivariate hypergeometric draw."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    start = F.struct(F.aggregate(caps, zero, add).alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, s):
        room = caps[s]
        return _let(
            hypergeometric(room, acc["total"], acc["drawn"], _uniform(*keys, s)),
            lambda x: F.struct((acc["total"] - room).alias("total"), (acc["drawn"] - x).alias("drawn"), F.concat(acc["out"], F.array(x)).alias("out")),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step)["out"]


def _halved(nodes: DataFrame, shards: int, seed: int, level: int, most: int) -> DataFrame:
    """nodes(ns array of (child, n), caps), at most `most` children each: (child, caps), each child's share of the room in the shards.

    The children of a node are halved again and again; each half gets its share by
    one draw. A draw is keyed by the level of nodes, the halving and the half's first child.
    """
    zero = F.lit(0).cast("long")
    nodes = nodes.select(F.col("ns")[0]["child"].alias("first"), "ns", "caps")
    for step in range(math.ceil(math.log2(most))):
        half = F.expr("size(ns) div 2").cast("int")
        left, right = F.slice("ns", 1, half), F.slice("ns", half + 1, F.size("ns") - half)
        drawn = F.aggregate(left, zero, lambda a, b: a + b["n"])
        cut = _split(F.col("caps"), drawn, shards, F.lit(seed), F.lit(level), F.lit(step), F.col("first"))
        nodes = nodes.select("first", "ns", "caps", F.when(F.size("ns") > 1, cut).alias("mine"))
        one = F.struct(F.col("first").alias("first"), F.col("ns").alias("ns"), F.col("caps").alias("caps"))
        two = F.array(
            F.struct(F.col("first").alias("first"), left.alias("ns"), F.col("mine").alias("caps")),
            F.struct(right[0]["child"].alias("first"), right.alias("ns"), F.zip_with("caps", "mine", lambda c, m: c - m).alias("caps")),
        )
        nodes = nodes.select(F.inline(F.when(F.size("ns") > 1, two).otherwise(F.array(one))))
    return nodes.select(F.col("ns")[0]["child"].alias("child"), "caps")


def communication_matrix(blocks: DataFrame, sizes: list[int], n_blocks: int, seed: int, fan: int = FAN) -> DataFrame:
    """blocks(block, n) and exact shard sizes: (block, sent), sent[s] rows going to shard s.

    Blocks are numbered and grouped by `fan`, these groups again, until one is left,
    so no row holds more than `fan` counts. From the top down each group's share of
    the room in the shards is dealt to its members, all groups of a level at once.
    """
    shards = len(sizes)
    # One row per block of rows, so one task can number them.
    numbered = blocks.withColumn("child", F.row_number().over(Window.orderBy("block")).cast("long") - 1)
    tables, most, members = [], [], numbered.select("child", "n")
    while True:
        most.append(max(1, min(fan, n_blocks)))
        grouped = members.groupBy(F.expr(f"child div {int(fan)}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("ns"), F.sum("n").alias("n"))
        tables.append(grouped)
        n_blocks = math.ceil(n_blocks / fan)
        if n_blocks <= 1:
            break
        members = grouped.select(F.col("at").alias("child"), "n")
    room = F.array(*[F.lit(x).cast("long") for x in sizes])
    nodes = tables[-1].select("ns", room.alias("caps"))
    for level in range(len(tables) - 1, -1, -1):
        dealt = _halved(nodes, shards, seed, level, most[level])
        if level:
            nodes = tables[level - 1].join(dealt.withColumnRenamed("child", "at"), "at").select("ns", "caps")
    return numbered.select("block", "child").join(dealt, "child").select("block", F.col("caps").alias("sent"))


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most; the first shards take what is over."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 17, block_bits: int = BLOCK_BITS) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard), a uniform shuffle with exact shard sizes.

    Pass only the columns that the placement should carry (keys, sizes): they
    travel twice. Each row is placed on its own, so nulls in any column, equal
    rows, repeated keys and empty or very long texts make no difference. An empty
    table gives an empty table. An input column named `shard` or `slot` is replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # Once written, the row numbers stay as they are, whichever tasks are run again.
    rows = written(df.select(*keep, F.monotonically_increasing_id().alias("_rm_row")), "shard-rows")
    block = F.shiftright("_rm_row", block_bits)
    blocks = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return rows.select(*keep, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    matrix = communication_matrix(blocks, shard_sizes(total, shards), n_blocks, seed)
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("sent", 1, s), F.lit(0).cast("long"), lambda a, b: a + b))
    matrix = matrix.select(F.col("block").alias("_rm_block"), upto.alias("_rm_upto"))
    local = Window.partitionBy("_rm_block").orderBy(F.xxhash64(F.lit(seed), F.lit(1), F.col("_rm_row")), "_rm_row")
    placed = (
        rows.withColumn("_rm_block", block)
        .withColumn("_rm_rank", F.row_number().over(local) - 1)
        .join(matrix, "_rm_block")
        .withColumn("shard", F.size(F.filter("_rm_upto", lambda c: c <= F.col("_rm_rank"))))
    )
    buckets = max(1, math.ceil(total / shards / 2**block_bits))
    key = F.xxhash64(F.lit(seed), F.lit(2), F.col("_rm_row"))
    placed = placed.select(
        *keep, "_rm_row", "shard", key.alias("_rm_key"), F.floor(_uniform(F.lit(seed), F.lit(3), F.col("_rm_row")) * buckets).cast("int").alias("_rm_bucket")
    )
    placed = written(placed, "shard-placed")
    offsets = placed.groupBy("shard", "_rm_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_rm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "_rm_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rm_before"))
    within = Window.partitionBy("shard", "_rm_bucket").orderBy("_rm_key", "_rm_row")
    return (
        placed.withColumn("_rm_at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "_rm_bucket"])
        .select(*keep, "shard", (F.col("_rm_before") + F.col("_rm_at")).cast("long").alias("slot"))
    )


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Every document's place: doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null under this law).

    size is the UTF-8 bytes of the text plus 1; a null text has 0 bytes and the checksum of an empty text.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(keys, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
