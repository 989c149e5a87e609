"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of Unicode letters, marks and digits; where a script sets no blanks
between words, each character is a token. A seed is the hash of six tokens at the
places of a fixed mask; the places between are ignored, so a substituted token
there doesn't break the seed. The masks below hit every stretch of 12 tokens or more
with at most 20 % substitutions: up to 60 tokens a test finds the fewest substitutions
that escape them all, and a longer stretch holds 12 tokens with at most 2. Items under
12 tokens have one seed, of all their tokens. The seeds of the documents are joined
with those of the benchmark, and where the two have one in common their token
sequences are laid side by side at every shift that a common seed shows: an overlap is
the longest stretch with at least 80 % equal tokens.

One way for a benchmark of any size: a filter of fixed size, made of all benchmark
seeds, goes to the tasks that read the documents; only documents with a seed that
passes it are written with those seeds, and the join is made on these.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, small, written

#: Fixed seed masks: the places, from a window's first token, that are hashed.
MASKS = (
    (0, 1, 2, 4, 6, 7),
    (0, 2, 3, 6, 7, 8),
    (0, 1, 2, 3, 4, 6),
    (0, 1, 5, 7, 8, 9),
)
#: Shortest overlap in tokens, and the share of them that must be equal.
MIN_OVERLAP, MIN_EQUAL = 12, 0.8
#: Items of at least this many tokens but under MIN_OVERLAP match whole and unchanged. One or two words are no evidence of a leak, so shorter ones match nothing.
MIN_ITEM = 3
#: Bits of the filter that every task holds, whatever the benchmark's size (16 MB); it passes what isn't in the benchmark now and then, and never stops what is.
FILTER_BITS = 1 << 27
#: Pairs of places of repeated seeds that are written out; more are found by a convolution.
PAIRS = 1 << 20

_SLICE = 1 << 20
_rng = np.random.default_rng(20)
_ODD = lambda n: _rng.integers(0, 2**64, n, np.uint64) | np.uint64(1)
_BYTE, _BASE, _TIMES = _ODD(256), int(_ODD(1)[0]), _ODD(64)
# Kana, ideographs, and the scripts of South-East Asia that are written without blanks.
_SINGLE = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAA60, 0xAA80), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x1B000, 0x1B170), (0x20000, 0x32000))
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_classes: list[np.ndarray] = []


def _class_of(points: np.ndarray) -> np.ndarray:
    """0 for separators, 1 for what makes up words, 2 for characters that are tokens by themselves."""
    if not _classes:
        found = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), np.uint8, 0x110000)
        for lo, hi in _SINGLE:
            found[lo:hi] *= 2
        _classes.append(found)
    return _classes[0][points]


_tables: list[np.ndarray] = []


@dataclass
class Tokens:
    """Tokens of several texts: hash, first and last-plus-one byte, and the text's number."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def tokens(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """The tokens of an Arrow array of texts (null as empty), A-Z lower-cased; the texts' bytes, and where each text begins in them.

    Long arrays are worked off in slices, which are cut between tokens.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return Tokens(none.astype(np.uint64), none, none, none), np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, ends = _places(data, offsets)
    hashes, at = [none.astype(np.uint64)], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        hashes.append(_hashes(data, starts[at:to], ends[at:to]))
        at = to
    return Tokens(np.concatenate(hashes), starts, ends, np.searchsorted(offsets, starts, "right") - 1), data, offsets


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each token."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _class_of(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32))
    sizes = np.diff(np.r_[lead, len(data)])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.r_[np.uint8(0), kind[:-1]]
    begins = (kind > 0) & ((before != 1) | (kind == 2) | first[lead])
    stops = (kind > 0) & np.r_[(kind[1:] == 0) | begins[1:], True]
    return lead[begins], (lead + sizes)[stops]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    piece = data[starts[0] : ends[-1]]
    if not _tables or len(_tables[0]) < len(piece):
        n = max(_SLICE, len(piece))
        _tables[:] = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_BYTE[piece] * _tables[0][: len(piece)], out=sums[1:])
    starts, ends = starts - starts[0], ends - starts[0]
    return (sums[ends] - sums[starts]) * _tables[1][starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _seeds(t: Tokens, places: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of every window of the mask that lies in one text."""
    n = len(t.hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, salt, np.uint64)
    for k, p in enumerate(places):
        h += t.hashes[p : p + n] * _TIMES[k]
    at = np.flatnonzero(t.text[:n] == t.text[places[-1] :])
    return at, _mixed(h[at])


def _masks(lengths: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    return [(i + 1, m) for i, m in enumerate(MASKS)] + [(1000 + n, tuple(range(n))) for n in lengths]


def _item_seeds(t: Tokens, n_texts: int, min_item: int = MIN_ITEM) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Seeds of benchmark texts: (salt, text, token of all tokens, hash) by mask; short items have one over all their tokens."""
    count = np.bincount(t.text, minlength=n_texts)
    found = []
    for salt, places in _masks(tuple(sorted({int(n) for n in count if min_item <= n < MIN_OVERLAP}))):
        at, h = _seeds(t, places, salt)
        size = count[t.text[at]]
        right = size >= MIN_OVERLAP if salt < 1000 else size == len(places)
        found.append((salt, t.text[at[right]], at[right], h[right]))
    return found


def _shifts(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The different values of a place of `mine` minus a place of `theirs`, without writing out all pairs where they are many."""
    if len(mine) * len(theirs) <= PAIRS:
        return np.unique(mine[:, None] - theirs)
    lo, hi = mine.min(), theirs.max()
    a, b = np.zeros(mine.max() - lo + 1), np.zeros(hi - theirs.min() + 1)
    a[mine - lo] = 1
    b[hi - theirs] = 1
    size = 1 << (len(a) + len(b) - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)
    return np.flatnonzero(both > 0.5) + lo - hi


class Sides:
    """One text and the benchmark items that may overlap it."""

    def __init__(self, text: str, items: list[str], min_item: int = MIN_ITEM):
        self.x, self.data, _ = tokens(pa.array([text], pa.large_string()))
        self.y, _, _ = tokens(pa.array(items, pa.large_string()))
        self.first = np.searchsorted(self.y.text, np.arange(len(items) + 1))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.item_seeds = _item_seeds(self.y, len(items), min_item)

    def _mine(self, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the text's seeds, by hash."""
        if salt not in self.seeds:
            at, h = _seeds(self.x, MASKS[salt - 1] if salt < 1000 else tuple(range(salt - 1000)), salt)
            order = np.argsort(h, kind="stable")
            self.seeds[salt] = at[order], h[order]
        return self.seeds[salt]

    def shifts(self, item: int) -> np.ndarray:
        """Every token of the text minus token of the item at which the two have a seed in common, in order."""
        found = [np.zeros(0, np.int64)]
        for salt, of, at, h in self.item_seeds:
            a, b = np.searchsorted(of, [item, item + 1])
            if a == b:
                continue
            my_at, my_h = self._mine(salt)
            at, h = at[a:b] - self.first[item], h[a:b]
            lo, hi = np.searchsorted(my_h, h, "left"), np.searchsorted(my_h, h, "right")
            n = hi - lo
            if n.sum() <= PAIRS:
                which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.unique(my_at[which] - np.repeat(at, n)))
            else:
                _, firsts = np.unique(h, return_index=True)
                found += [_shifts(my_at[lo[k] : hi[k]], at[h == h[k]]) for k in firsts.tolist() if n[k]]
        return np.unique(np.concatenate(found))

    def overlap(self, item: int) -> tuple[int, int, int, int, int] | None:
        """(equal tokens, tokens, first token in the item, first and last-plus-one code point in the text) of the best overlap: the longest, then the one with most equal tokens, then the first."""
        x, y = self.x.hashes, self.y.hashes[self.first[item] : self.first[item + 1]]
        best, where = (0, 0), None
        for shift in self.shifts(item).tolist():
            a, b = max(0, shift), min(len(x), len(y) + shift)
            if b - a < best[0]:
                continue
            equal = x[a:b] == y[a - shift : b - shift]
            n = int(equal.sum())
            if len(y) < MIN_OVERLAP:
                if n == len(y):
                    best, where = (n, n), (a, b, 0)
                    break
                continue
            if n < max(MIN_EQUAL * MIN_OVERLAP, MIN_EQUAL * best[0]):
                continue
            s, e = longest(equal)
            rank = (e - s, int(equal[s:e].sum()))
            if e - s >= MIN_OVERLAP and rank > best:
                best, where = rank, (a + s, a + e, a + s - shift)
                # Nothing can be longer than the shorter of the two, and later shifts begin later.
                if rank == (min(len(x), len(y)),) * 2:
                    break
        if where is None:
            return None
        begin, upto = int(self.x.starts[where[0]]), int(self.x.ends[where[1] - 1])
        chars = np.flatnonzero((self.data[:upto] & 0xC0) != 0x80)
        return best[1], best[0], where[2], int(np.searchsorted(chars, begin)), len(chars)


def longest(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch, from an equal token to an equal token, with at least MIN_EQUAL equal ones; the first of several."""
    score = np.r_[0, np.cumsum(np.where(equal, 1 / MIN_EQUAL - 1, -1.0))]
    low = np.minimum.accumulate(score)
    best = (0, 0)
    # Only a new least prefix can start the longest stretch; it ends at the last place from where some prefix is no less.
    records = np.flatnonzero(np.r_[True, low[1:] < low[:-1]])
    high = np.maximum.accumulate(score[::-1])[::-1]
    places = np.flatnonzero(equal)
    for s in records.tolist():
        e = int(np.searchsorted(-high, -score[s], "right")) - 1
        inside = places[np.searchsorted(places, s) : np.searchsorted(places, e)]
        if len(inside) and inside[-1] + 1 - inside[0] > best[1] - best[0]:
            best = (int(inside[0]), int(inside[-1]) + 1)
    return best


# Seeds of the benchmark


def _items(benchmark: DataFrame) -> DataFrame:
    """(item bigint, item_id, text), a row for each different text; the least item_id stands for equal ones, -1 for none."""
    texts = benchmark.where("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.coalesce(F.min(F.col("item_id").cast("long")), F.lit(-1)).alias("item_id"))
    return texts.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")


def _seed_table(items: DataFrame, min_item: int) -> DataFrame:
    """(h, item, salt): the different seeds of each item."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            t, _, _ = tokens(batch.column(1))
            for salt, of, _, h in _item_seeds(t, batch.num_rows, min_item):
                rows = np.unique(np.stack([of.astype(np.uint64), h]), axis=1)
                mine = batch.column(0).take(pa.array(rows[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[1].astype(np.int64)), mine, pa.array(np.full(len(mine), salt, np.int32))], ["h", "item", "salt"])

    return items.select("item", "text").mapInArrow(each, "h long, item long, salt int")


def _probes(h: Column, bits: int) -> Column:
    """The two places of a seed in the filter."""
    return F.array(F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.lit(bits)))


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The bits of all seeds, in bytes; its size doesn't depend on how many there are."""
    places = seeds.select(F.explode(_probes(F.col("h"), bits)).alias("at")).select((F.col("at").cast("long") + 1).alias("at"))
    maps = places.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    found = np.zeros((bits // 32768 + 1, 4096), np.uint8)
    for k, part in zip(maps["k"].to_pylist(), maps["bits"].to_pylist()):
        found[k - 1] = np.frombuffer(part, np.uint8)
    return found.ravel()


def _passes(held: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for part in (h & np.uint64(0x7FFFFFFF), h >> np.uint64(32) & np.uint64(0x7FFFFFFF)):
        at = part % np.uint64(bits)
        ok &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


# Overlaps

_KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key of 128 bits that equal texts share."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), text.alias("text"))


def _candidates(keyed: DataFrame, seeds: DataFrame, bits: int) -> DataFrame:
    """The rows of keyed that have seeds which pass the filter, with these."""
    lengths = tuple(sorted(r.salt - 1000 for r in seeds.where("salt > 1000").select("salt").distinct().collect()))
    sent = keyed.sparkSession.sparkContext.broadcast(_filter(seeds, bits))
    place = keyed.columns.index("text")
    schema = keyed.withColumn("hs", F.array().cast("array<bigint>")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in small(batches):
            t, _, _ = tokens(batch.column(place))
            hits = []
            for salt, places in _masks(lengths):
                at, h = _seeds(t, places, salt)
                ok = _passes(held, bits, h)
                hits.append(np.stack([t.text[at[ok]].astype(np.uint64), h[ok]]))
            rows, hs = np.unique(np.concatenate(hits, axis=1), axis=1)
            which, n = np.unique(rows.astype(np.int64), return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(hs.astype(np.int64)))
            some = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, lists], schema.names)

    return keyed.mapInArrow(each, schema)


OVERLAPS = "item_id long, equal_tokens long, overlap_tokens long, item_token long, doc_start long, doc_end long"
#: Items of one text that are laid beside it in one row.
_DEALT = 32


def _pairs(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(k1, k2, item): every different candidate text and item with a common seed."""
    return candidates.select(*_KEY, F.explode("hs").alias("h")).distinct().join(seeds.select("h", "item"), "h").select(*_KEY, "item").distinct()


def _verified(candidates: DataFrame, pairs: DataFrame, items: DataFrame, min_item: int, one: bool) -> DataFrame:
    """(k1, k2, *OVERLAPS) of the pairs that overlap; with `one`, the rest of a row's items is left alone once one overlaps."""
    dealt = pairs.withColumn("part", F.expr(f"(row_number() OVER (PARTITION BY k1, k2 ORDER BY item) - 1) div {_DEALT}")).join(items, "item")
    rows = dealt.groupBy(*_KEY, "part").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"))).alias("items"))
    texts = candidates.groupBy(*_KEY).agg(F.first("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple] = []
            for row, text, mine in zip(range(batch.num_rows), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sides = Sides(text, [m["item_text"] for m in mine], min_item)
                for k, m in enumerate(mine):
                    if (found := sides.overlap(k)) is not None:
                        out.append((row, m["item_id"], *found))
                        if one:
                            break
            if out:
                columns = list(zip(*out))
                keys = [batch.column(k).take(pa.array(columns[0], pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in columns[1:])], [*_KEY, *(x.split()[0] for x in OVERLAPS.split(", "))])

    return texts.join(rows, _KEY).select(*_KEY, "text", "items").mapInArrow(each, f"k1 long, k2 long, {OVERLAPS}")


def _prepared(docs: DataFrame, benchmark: DataFrame, filter_bits: int, min_item: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, items and seeds, written."""
    items = written(_items(benchmark), "items")
    seeds = written(_seed_table(items, min_item), "item-seeds")
    return written(_candidates(_keyed(docs), seeds, filter_bits), "candidates"), items, seeds


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS, min_item: int = MIN_ITEM) -> DataFrame:
    """A row for each document and benchmark item that overlap: the longest overlap, and its code points in the text.

    Every row of docs is a document of its own, whatever its doc_id; a null text
    has no tokens and a null benchmark text no seeds. Of equal benchmark texts the
    least item_id stands for all (-1 where it is null). Of several overlaps with
    one item the longest counts, then the one with most equal tokens, then the
    first. Items of fewer than min_item tokens (at least 1) match nothing, those under
    MIN_OVERLAP only whole and unchanged. Empty tables give no rows. Only the
    columns named here are read. filter_bits changes the effort, not the result.
    """
    candidates, items, seeds = _prepared(docs, benchmark, filter_bits, min_item)
    found = written(_verified(candidates, _pairs(candidates, seeds), items, min_item, False), "overlaps")
    return candidates.select("doc_id", *_KEY).join(found, _KEY).drop(*_KEY)


def contaminated(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS, min_item: int = MIN_ITEM) -> DataFrame:
    """(k1, k2): the keys of the different texts that overlap any item, see _keyed().

    Where many items share a passage, a text that holds it needs one of them. So each
    text is laid beside the least item of each common seed first, and only texts that
    overlap none of these beside the others.
    """
    candidates, items, seeds = _prepared(docs, benchmark, filter_bits, min_item)
    firsts = seeds.groupBy("h").agg(F.min("item").alias("item"))
    first_pairs = written(_pairs(candidates, firsts), "first-pairs")
    found = written(_verified(candidates, first_pairs, items, min_item, True).select(*_KEY).distinct(), "overlaps")
    open_ones = written(candidates.join(found, _KEY, "left_anti"), "candidates")
    if not open_ones.limit(1).count():
        return found
    others = _pairs(open_ones, seeds).join(first_pairs, [*_KEY, "item"], "left_anti")
    more = written(_verified(open_ones, others, items, min_item, True).select(*_KEY).distinct(), "overlaps")
    return found.unionByName(more)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, filter_bits: int = FILTER_BITS, min_item: int = MIN_ITEM) -> DataFrame:
    """The rows of docs, all columns, whose text overlaps no benchmark item; see benchmark_overlaps().

    A row with a null or empty text stays, and rows that repeat stay or go together.
    Columns may have any names and types.
    """
    found = contaminated(docs, benchmark, filter_bits, min_item)
    text, keys = F.col("text").cast("string"), free_names(docs.columns, *_KEY)
    marked = docs.withColumns({k: F.xxhash64(F.lit(n + 1), text) for n, k in enumerate(keys)})
    return marked.join(found.withColumnsRenamed(dict(zip(_KEY, keys))), keys, "left_anti").select(*docs.columns)
