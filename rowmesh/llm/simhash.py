"""SimHash near-duplicates through anchor points of a covering code.

Fingerprints that differ in at most 3 of 64 bits differ in at most one bit of one
of the two 32-bit halves. The anchors of a half are the words of the [31,26]
Hamming code over its low 31 bits, whose covering radius is 1: every point is an
anchor or next to exactly one. A fingerprint is replicated to each anchor within
2 = covering radius 1 + threshold 1 of its half (1 or 16 anchors), so two
fingerprints whose halves differ in one bit meet at the anchor that covers either
of them, and are compared there over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import free_names, small, text_bytes, word_chunks, written
from .components import connected_components

SHINGLE = 3
THRESHOLD = 3
#: Members of one anchor that are compared in one task; larger groups are split into cells of two parts.
PART = 2048


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text: XXH64 (seed 42) of its word shingles, repeats included.

    A-Z are lower-cased. A text of fewer words has its whole sequence as one
    shingle; a null text or one without words has fingerprint 0.
    """
    counts, n, carry, ever = np.zeros(64, np.int64), 0, [], False
    digest = xxhash.xxh64_intdigest
    for words in word_chunks(text_bytes(text).lower()):
        words = carry + words
        if len(words) >= shingle:
            line = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
            hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
            counts += _bit_counts(hashes)
            n += len(hashes)
            ever = True
            words = words[len(words) - shingle + 1 :]
        carry = words
    if not ever:
        if not carry:
            return 0
        counts, n = _bit_counts([digest(b" ".join(carry), 42)]), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, fp) of every row: fp as a signed long, text_hash the xxhash64 of the text (null as empty)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return slim.mapInArrow(each, "doc_id long, text_hash long, fp long")


def _anchors(half: Column) -> Column:
    """The code words within distance 2 of a 31-bit number, as an array."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    syndrome = sum((F.bit_count(half.bitwiseAND(F.lit(m).cast("long"))) % 2) * (1 << k) for k, m in enumerate(masks))
    # The bit of position p; position 0 stands for none.
    bits = F.array(*[F.lit(0 if p == 0 else 1 << (p - 1)).cast("long") for p in range(32)])

    def around(s):
        places = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i <= i.bitwiseXOR(s["s"]))
        flipped = F.transform(places, lambda i: half.bitwiseXOR(s["bits"][i]).bitwiseXOR(s["bits"][i.bitwiseXOR(s["s"])]))
        return F.when(s["s"] == 0, F.array(half)).otherwise(flipped)

    return F.transform(F.array(F.struct(syndrome.cast("int").alias("s"), bits.alias("bits"))), around)[0]


def at_anchors(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct: (anchor, fp), each fingerprint at every anchor near one of its halves."""
    ones = F.lit((1 << 31) - 1).cast("long")
    low, high = F.col("fp").bitwiseAND(ones), F.shiftrightunsigned("fp", 32).bitwiseAND(ones)
    upper = F.transform(_anchors(high), lambda a: a + F.lit(1 << 31).cast("long"))
    return fps.select(F.explode(F.concat(_anchors(low), upper)).alias("anchor"), "fp")


def _forest(members: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Links among the members that connect all that chains of links up to the threshold connect, one per member at most."""
    a, b = [], []
    rest = members
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                hits = rest[near]
                rest = rest[~near]
                a += [int(x)] * len(hits)
                b += hits.tolist()
                front += list(hits)
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, cell, fp) in order of anchor and cell: links (a, b) within each."""
    held: list[np.ndarray] = []

    def compare(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(fps)]
        sizes = ends - starts
        first = starts[sizes == 2]
        near = np.bitwise_count(fps[first] ^ fps[first + 1]) <= THRESHOLD
        a, b = fps[first[near]].tolist(), fps[first[near] + 1].tolist()
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            x, y = _forest(fps[s:e], THRESHOLD)
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            rows = np.concatenate(held)
            same = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            # The last group may go on in the next batch.
            cut = len(rows) - (len(same) if same.all() else int(np.argmin(same[::-1])))
            if cut:
                yield compare(rows[:cut, :2], rows[:cut, 2].astype(np.int64).view(np.uint64))
                held = [rows[cut:]]
    if held and len(held[0]):
        rows = np.concatenate(held)
        yield compare(rows[:, :2], rows[:, 2].astype(np.int64).view(np.uint64))


def links(fps: DataFrame, part: int = PART) -> DataFrame:
    """fps(fp), distinct: (a, b), links of at most 3 bits that connect whatever such links connect at all.

    Anchors with one fingerprint are dropped, as it has no partner there. A group
    of over `part` members is cut into parts by hash, and every two parts are a
    cell of their own, so that no task has to hold or compare a group of any size.
    Groups are counted with partial sums and the counts joined back, a join whose
    heavy keys Spark can split. It is a merge, as Spark sizes points by the fingerprints,
    a thirtieth of them, and would send them to every task.
    """
    points = at_anchors(fps).hint("merge")
    met = points.join(points.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchor")
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: (F.least(j, mine) * parts + F.greatest(j, mine)).cast("long"))
    cells = met.select("anchor", F.explode(other).alias("cell"), "fp")
    return cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_links, "a long, b long")


def components(keyed: DataFrame) -> DataFrame:
    """keyed(doc_id, ..., fp): its rows with root and component_id, the least doc_id that links of at most 3 bits reach.

    A component whose ids are all null has a null id. Rows that share a doc_id are
    rows of their own: only their fingerprints link them.
    """
    nodes = keyed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A merge, so that a table with a row for each document is never broadcast, however small its file is.
    return keyed.hint("merge").join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see fingerprint() and components()."""
    keyed = written(fingerprints(docs).drop("text_hash"), "fingerprints")
    return components(keyed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashable(docs: DataFrame, column: str) -> Column:
    """A column as it can be hashed: maps by their entries in order, what holds maps as text."""
    kind = docs.schema[column].dataType
    if isinstance(kind, MapType) and not any(x in kind.valueType.simpleString() for x in ("map<", "variant")):
        return F.array_sort(F.map_entries(column))
    if any(x in kind.simpleString() for x in ("map<", "variant")):
        return F.to_json(F.struct(column))
    return F.col(column)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id, and of rows that share it the one whose text hash is least.

    All columns stay, whatever their names and types. Of rows alike in doc_id and text
    the one with the least hash of all columns stays, of rows equal in all columns one. A
    component without any doc_id keeps one row. Null and empty texts have fingerprint 0
    and so are one component. An empty table gives an empty one.
    """
    columns, keys = docs.columns, free_names(docs.columns, "_id", "_text", "_all")
    count = free_names([*docs.columns, *keys], "_n")[0]
    keyed = written(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first")
    best = components(keyed).groupBy("root").agg(first).select(F.col("first.doc_id").alias(keys[0]), F.col("first.text_hash").alias(keys[1]))
    marked = docs.withColumns(dict(zip(keys, (F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*[_hashable(docs, c) for c in columns])))))
    alike = _within(marked.select(*keys), best, keys[:2])
    chosen = written(alike.groupBy(*keys[:2]).agg(F.min(keys[2]).alias(keys[2]), F.count(F.lit(1)).alias(count)), "chosen")
    # Nearly always one row has that id and text; only the others are grouped, and so moved, with their texts.
    one = _within(marked, chosen.where(F.col(count) == 1), keys)
    several = _within(marked, chosen.where(F.col(count) > 1), keys).dropDuplicates(keys)
    return one.unionByName(several).select(*columns)


def _within(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys, nulls too, are among the chosen ones."""
    return rows.alias("r").join(chosen.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "left_semi")
