"""Periodic runs of words through an enhanced suffix array.

A run is a stretch of words with a smallest period q that no neighbouring word
extends. Its last square, two copies of q words that end where the run ends, branches:
the suffixes at the two copies agree in exactly q words. So both lie in one LCP
interval of depth q, in different children of it. For each place where an interval is
parted, the suffixes i of the smaller side look up, by the inverse suffix array,
whether i + q or i - q lies in the other side: each suffix is on a smaller side at
most log n times. Squares are then rotated to the left as far as their period lasts,
and those that lie in a run of a period that divides theirs are merged into it.

Tasks work on slices of documents, whose words become numbers with Arrow and numpy.
Every run, of 12 words or more, is covered by stretches of six words that the document
holds twice, so only words under such stretches enter the suffix array: sequences of
different documents and stretches are set apart by symbols of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, text_bytes

#: Shortest run in words; it also has at least two periods.
LEAST = 12
#: Words of a stretch that must come twice: any run of LEAST words is covered by such stretches of half its length.
_GRAM = LEAST // 2
#: Suffixes that are looked up at once.
_AT_ONCE = 1 << 21
# What parts words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of several texts: their bytes, a number for each that equal words share, and where each text begins (one more at the end)."""

    words: pa.Array
    ids: np.ndarray
    first: np.ndarray


def split(texts: list[bytes]) -> Words:
    """The words of the texts in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    offsets = np.r_[0, np.cumsum(ends - begins)].astype(np.int64)
    packed = data[~blank]
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(words, ids, np.searchsorted(begins, starts))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places whose words stand at 0 to n - 1, where the document's number says that they repeat; None where the words stay."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _covered(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each word lies in a stretch of _GRAM words that its text holds twice. Hashes only choose: a false hit covers words that need it not."""
    n = len(ids) - _GRAM + 1
    if n <= 1:
        return np.zeros(len(ids), bool)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = of[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(_GRAM):
        h = (h ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(of[:n] == of[_GRAM - 1 :])
    h = h[whole]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = whole[np.concatenate([order[1:][same], order[:-1][same]])]
    depth = np.zeros(len(ids) + 1, np.int32)
    places = np.unique(again)
    depth[places] += 1
    np.subtract.at(depth, places + _GRAM, 1)
    return np.cumsum(depth[:-1]) > 0


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, place of each in that order, classes of the stretches of 1, 2, 4, ... symbols) of a sequence whose last symbol is found nowhere else."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    classes, size, m = [rank], 1, len(symbols)
    while True:
        after = np.zeros(m, np.int64)
        after[: m - size] = rank[size:].astype(np.int64) + 1
        pairs = rank.astype(np.int64) * (m + 1) + after
        order = np.argsort(pairs, kind="stable")
        fresh = np.r_[False, pairs[order[1:]] != pairs[order[:-1]]]
        rank = np.empty(m, np.int32)
        rank[order] = np.cumsum(fresh)
        if fresh[1:].all():
            return order, rank.astype(np.int64), classes
        classes.append(rank)
        size *= 2


def _common(a: np.ndarray, b: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """How many symbols from a and from b on are equal, for each pair of different places."""
    a, b = a.copy(), b.copy()
    n = np.zeros(len(a), np.int64)
    for k in range(len(classes) - 1, -1, -1):
        hop = np.where(classes[k][a] == classes[k][b], 1 << k, 0)
        a += hop
        b += hop
        n += hop
    return n


def _common_before(a: np.ndarray, b: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """How many symbols that end right before a and before b are equal."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(classes) - 1, -1, -1):
        size = 1 << k
        x, y = a - n - size, b - n - size
        inside = (x >= 0) & (y >= 0)
        n += np.where(inside & (classes[k][np.maximum(x, 0)] == classes[k][np.maximum(y, 0)]), size, 0)
    return n


def _parts(lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each place k of the LCP array: the last place before it that is no greater, and the first after it that is less; -1 stands at both ends."""
    left, right, stack = [0] * len(lcp), [0] * len(lcp), [0]
    for k in range(1, len(lcp)):
        v = lcp[k]
        while lcp[stack[-1]] > v:
            right[stack.pop()] = k
        left[k] = stack[-1]
        stack.append(k)
    return left, right


def _squares(order: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of all branching squares, in order of both."""
    left, right = (np.array(x, np.int64) for x in _parts(lcp.tolist()))
    parted = np.flatnonzero(lcp > 0)
    lo, hi = left[parted], right[parted]
    before = parted - lo <= hi - parted
    # The smaller side's suffixes look into the other.
    mine_lo, mine_hi = np.where(before, lo, parted), np.where(before, parted, hi)
    other_lo, other_hi = np.where(before, parted, lo), np.where(before, hi, parted)
    size = mine_hi - mine_lo
    upto = np.cumsum(size)
    found, at, m = [], 0, len(order)
    while at < len(parted):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _AT_ONCE)))
        n = size[at:to]
        which = np.repeat(np.arange(at, to), n)
        suffix = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + mine_lo[which]]
        depth = lcp[parted[which]]
        for other, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
            inside = (other >= 0) & (other < m)
            there = place[np.where(inside, other, 0)]
            hit = inside & (there >= other_lo[which]) & (there < other_hi[which])
            found.append((start[hit] + 2 * depth[hit]) * (m + 1) + depth[hit])
        at = to
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // (m + 1), keys % (m + 1)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of LEAST symbols and two periods or more, in order of start and period; the last symbol is found nowhere else."""
    order, place, classes = suffix_array(symbols)
    lcp = np.full(len(symbols) + 1, -1, np.int64)
    lcp[1:-1] = _common(order[:-1], order[1:], classes)
    end, period = _squares(order, place, lcp)
    found = []
    # Squares of one end by period: the first has its smallest period, and takes those of multiples with it that its run covers.
    while len(end):
        first = np.r_[True, end[1:] != end[:-1]]
        e, q = end[first], period[first]
        start = e - 2 * q - _common_before(e - 2 * q, e - q, classes)
        found.append(np.stack([start, e - start, q], axis=1))
        mine = np.cumsum(first) - 1
        rest = ~first & ~((period % q[mine] == 0) & (start[mine] <= end - 2 * period))
        end, period = end[rest], period[rest]
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(LEAST, 2 * rows[:, 2])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def word_runs(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of equal numbers within each text; `of` is each word's text, start a place in ids."""
    covered = _covered(ids, of)
    places = np.flatnonzero(covered)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    # A symbol of its own after each stretch, greater than all words.
    last = np.r_[(np.diff(places) > 1) | (of[places[1:]] != of[places[:-1]]), True]
    to = np.arange(len(places)) + np.r_[0, np.cumsum(last[:-1])]
    m = len(places) + int(last.sum())
    back = np.zeros(m, np.int64)
    back[to] = places
    n = int(ids.max()) + 1
    symbols = np.zeros(m, np.int64)
    # Words of different texts are different symbols, so no interval goes beyond one text.
    symbols[to] = of[places] * n + ids[places]
    ends = to[last] + 1
    symbols[ends] = (int(of[places[-1]]) + 1) * n + np.arange(len(ends))
    rows = runs_of(symbols)
    rows[:, 0] = back[rows[:, 0]]
    return rows


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
_NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _slice(doc_ids: list[int | None], texts: list[bytes], plant: bool) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words as they count, rows of runs, where each text's rows begin, and the places of the words that stay and where each text's begin."""
    w = split(texts)
    if plant:
        take = np.arange(len(w.ids))
        for k, doc_id in enumerate(doc_ids):
            a, b = w.first[k : k + 2].tolist()
            if (at := planted(doc_id, b - a)) is not None:
                take[a:b] = at + a
        w = Words(w.words.take(pa.array(take)), w.ids[take], w.first)
    of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    rows = word_runs(w.ids, of)
    cuts = np.searchsorted(rows[:, 0], w.first)
    depth = np.zeros(len(w.ids) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.subtract.at(depth, rows[:, 0] + rows[:, 1], 1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return w, rows, cuts, kept, np.searchsorted(kept, w.first)


def _joined(w: Words, kept: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    words = w.words if len(kept) == len(w.words) else w.words.take(pa.array(kept))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), words), pa.scalar(b" ", pa.large_binary()))


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """RUNS for each document: how many runs of words it has, the longest one, and hashes of all runs and of the words outside repeats.

    A run has at least 12 words and two of its periods; of runs equally long the one
    with the least start counts, then the least period. A word goes if it lies in
    any run behind that run's first period. With plant, documents whose number's
    checksum ends in 0 repeat a part of their own words first; a null doc_id has no
    such number. A null or empty text has no words and no runs, so nulls for the
    longest one and hashes of nothing. Texts are read whole, each in one task, so equal
    rows give equal results; other columns don't matter; no documents give no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 512, 4 << 20):
            texts = [text_bytes(t) for t in batch.column(1).to_pylist()]
            w, rows, cuts, kept, kept_cuts = _slice(batch.column(0).to_pylist(), texts, plant)
            out = []
            for k, text in enumerate(_joined(w, kept, kept_cuts)):
                mine = rows[cuts[k] : cuts[k + 1]] - (int(w.first[k]), 0, 0)
                longest: tuple = (None,) * 4
                if len(mine):
                    s, n, q = mine[int(np.argmax(mine[:, 1]))].tolist()
                    longest = s, n, q, 1000 * n // q
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
                n_words = int(w.first[k + 1] - w.first[k])
                out.append((len(mine), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.as_buffer()).hexdigest(), n_words, n_words - int(kept_cuts[k + 1] - kept_cuts[k])))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, RUNS)


def collapsed(docs: DataFrame) -> DataFrame:
    """docs, all columns, whose texts keep only the first period of each run, words joined by one blank; texts without a run, and null ones, stay as they are."""
    place = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 512, 4 << 20):
            texts = batch.column(place).to_pylist()
            w, _, cuts, kept, kept_cuts = _slice([], [text_bytes(t) for t in texts], False)
            new = [t if a == b else short.as_buffer().to_pybytes().decode() for t, short, a, b in zip(texts, _joined(w, kept, kept_cuts), cuts, cuts[1:])]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(each, docs.schema)
