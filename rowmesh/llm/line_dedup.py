"""Lines that many documents share, found by two Bloom filters.

Every task puts the keys of its lines into two filters, of keys that came once and of
those that came again in another document; a key in the first filters of two tasks
came twice as well. Only lines whose key passes the merged second filter, the
suspected repeats, are counted exactly, by 128-bit digests of which one is shuffled
for each key and task. Confirmed keys go to the tasks that rewrite the texts, or,
where there are too many, are joined with the texts that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import free_names, small, text_bytes, written

#: Documents that must hold a line.
LEAST_DOCS = 10
#: Confirmed keys that every task holds (40 bytes each); more are joined.
MOST_KEYS = 1 << 21
#: Keys that a task counts before it passes them on.
_HELD = 1 << 16
# What is cut off at both ends of a line.
_BLANKS = b" \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: blanks cut off at both ends, A-Z lower-cased."""
    return [x.strip(_BLANKS).lower() for x in text.split(b"\n")]


def _digests(keys: list[bytes]) -> np.ndarray:
    """Rows (h1, h2) of 128 bits that stand for the keys; two of 10^12 different ones share theirs with a chance of about 10^-15."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


def _filters(lines: DataFrame, bits: int) -> np.ndarray:
    """The filter of keys that at least two documents hold."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in small(batches):
            seen = seen or bloom.OnceTwice(bits)
            found = [b"".join(map(xxhash.xxh3_128_digest, set(line_keys(text_bytes(t))) - {b""})) for t in batch.column(0).to_pylist()]
            seen.add(np.frombuffer(b"".join(found), ">u8")[::2].astype(np.uint64))
        if seen:
            yield from seen.blocks()

    return bloom.twice_filter(lines.select("text").mapInArrow(each, "block int, once binary, twice binary"), bits)


def _suspects(docs: DataFrame, held: np.ndarray) -> DataFrame:
    """(h1, h2, n, no, doc_id, line): keys that pass the filter, in how many documents of a task, and the first line that has them."""
    sent = docs.sparkSession.sparkContext.broadcast(held)
    names = ["h1", "h2", "n", "no", "doc_id", "line"]

    def rows(counts: dict[bytes, list]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(counts), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
        n, no, doc_id, line = zip(*((n, *first) for n, first in counts.values()))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n, pa.int64()), pa.array(no, pa.bool_()), pa.array(doc_id, pa.int64()), pa.array(line, pa.int64())], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list] = {}
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first: dict[bytes, int] = {}
                for k, key in enumerate(line_keys(text_bytes(text))):
                    first.setdefault(key, k)
                first.pop(b"", None)
                if not first:
                    continue
                digests = list(map(xxhash.xxh3_128_digest, first))
                ok = bloom.passes(sent.value, np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64))
                places = list(first.values())
                for k in np.flatnonzero(ok).tolist():
                    here = (doc_id is None, doc_id or 0, places[k])
                    if (old := counts.get(digests[k])) is None:
                        counts[digests[k]] = [1, here]
                    else:
                        old[0] += 1
                        old[1] = min(old[1], here)
            if len(counts) > _HELD:
                yield rows(counts)
                counts = {}
        if counts:
            yield rows(counts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "h1 long, h2 long, n long, no boolean, doc_id long, line long")


def repeated_keys(docs: DataFrame, least_docs: int = LEAST_DOCS, filter_bits: int | None = None) -> DataFrame:
    """(h1, h2, n, no, doc_id, line): digests of the keys that at least `least_docs` (two or more) documents hold, how many do, and the first line with the key, by doc_id (null last, then `no`) and place.

    Every row of docs is a document of its own, and an empty key is none. filter_bits
    (a power of two up to 2^31) changes the effort, not the result.
    """
    if least_docs < 2:
        raise ValueError("least_docs is at least 2")
    held = _filters(docs, filter_bits or bloom.bits_for(docs))
    first = F.min(F.struct("no", "doc_id", "line")).alias("first")
    found = _suspects(docs, held).groupBy(*_KEY).agg(F.sum("n").alias("n"), first).where(F.col("n") >= least_docs)
    return found.select(*_KEY, "n", "first.no", "first.doc_id", "first.line")


class Known:
    """Confirmed keys in order, each with its first line."""

    def __init__(self, h1, h2, no, doc_id, line):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.no, self.doc_id, self.line = (np.asarray(x)[order] for x in (h1, h2, no, doc_id, line))

    def dropped(self, doc_id: int | None, text: bytes, keep_first: bool) -> tuple[list[bytes], np.ndarray]:
        """The text's lines, and which of them go."""
        keys = line_keys(text)
        gone = np.zeros(len(keys), bool)
        if not len(self.h1):
            return text.split(b"\n"), gone
        h = _digests(keys)
        lo, hi = np.searchsorted(self.h1, h[:, 0], "left"), np.searchsorted(self.h1, h[:, 0], "right")
        filled = np.fromiter(map(len, keys), np.int64, len(keys)) > 0
        for k in np.flatnonzero((lo < hi) & filled).tolist():
            for at in range(lo[k], hi[k]):
                if self.h2[at] == h[k, 1]:
                    here = (doc_id is None, doc_id or 0, k)
                    gone[k] = not (keep_first and here == (self.no[at], self.doc_id[at], self.line[at]))
        return text.split(b"\n"), gone


def _known(table: pa.Table | pa.StructArray) -> Known:
    column = (lambda c: table[c].to_numpy()) if isinstance(table, pa.Table) else (lambda c: table.field(c).to_numpy(zero_copy_only=False))
    return Known(*(column(c).view(np.uint64) for c in _KEY), *(column(c) for c in ("no", "doc_id", "line")))


def _marked(docs: DataFrame, keys: DataFrame, names: list[str]) -> tuple[DataFrame, object]:
    """docs with a column of each row's keys, and the keys that all rows share; one of both is None."""
    if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        return docs, docs.sparkSession.sparkContext.broadcast(_known(keys.toArrow()))
    bits = bloom.bits_for(keys)
    sent = docs.sparkSession.sparkContext.broadcast(bloom.table_filter(keys, "h1", bits))
    own = [F.xxhash64(F.lit(k), "text") for k in (1, 2)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for row, text in enumerate(batch.column(2).to_pylist()):
                if filled := set(line_keys(text_bytes(text))) - {b""}:
                    h = _digests(list(filled))
                    h = h[bloom.passes(sent.value, h[:, 0])].view(np.int64)
                    text_key = [pa.array([batch.column(c)[row].as_py()] * len(h), pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*text_key, pa.array(h[:, 0]), pa.array(h[:, 1])], ["t1", "t2", *_KEY])

    texts = docs.select(own[0].alias("t1"), own[1].alias("t2"), "text")
    held = texts.mapInArrow(each, "t1 long, t2 long, h1 long, h2 long").distinct()
    # A text's own keys: no more than it has lines.
    lists = held.join(keys, _KEY).groupBy("t1", "t2").agg(F.collect_list(F.struct(*_KEY, "no", "doc_id", "line")).alias(names[2]))
    marked = docs.withColumns({names[0]: own[0], names[1]: own[1]})
    joined = marked.join(lists.withColumnsRenamed({"t1": names[0], "t2": names[1]}), names[:2], "left")
    return joined.select(*docs.columns, names[2]), None


def _each(docs: DataFrame, keys: DataFrame, keep_first: bool, give, schema) -> DataFrame:
    """give(batch, [(lines, which go) of each row]) over docs(doc_id, text, ...)."""
    columns = docs.columns
    marked, shared = _marked(docs, keys, free_names(columns, "_t1", "_t2", "_keys"))
    at, of = columns.index("doc_id"), columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts = batch.column(at).to_pylist(), batch.column(of).to_pylist()
            if shared is not None:
                known = [shared.value] * batch.num_rows
            else:
                lists = batch.column(len(columns))
                known = [_known(lists.slice(k, 1).flatten()) for k in range(batch.num_rows)]
            yield give(batch.select(range(len(columns))), [x.dropped(i, text_bytes(t), keep_first) for x, i, t in zip(known, ids, texts)])

    return marked.mapInArrow(each, schema)


def _kept(lines: list[bytes], gone: np.ndarray) -> bytes:
    return b"\n".join(x for x, g in zip(lines, gone.tolist()) if not g) if gone.any() else b"\n".join(lines)


def line_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document; see drop_repeated_lines()."""
    keys = written(repeated_keys(docs, least_docs, filter_bits), "line-keys")

    def give(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        sha = [hashlib.sha256(_kept(*x)).hexdigest() for x in found]
        sizes = pa.array([len(x) for x, _ in found], pa.int64()), pa.array([int(g.sum()) for _, g in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _each(slim, keys, keep_first, give, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, keep_first: bool = False, filter_bits: int | None = None) -> DataFrame:
    """docs, all columns, without the lines whose key at least `least_docs` documents hold.

    Lines end at line feeds; a line's key is it without blanks at both ends, A-Z
    lower-cased. Lines with an empty key stay. A document counts once for a key,
    however often it holds it; every row is a document of its own. With keep_first
    the first line that has the key stays: that of the least doc_id (null last), and in
    there the first; rows that share this doc_id and place keep theirs alike. A null
    text is one empty line, and stays null. No documents give no rows.
    """
    keys = written(repeated_keys(docs, least_docs, filter_bits), "line-keys")
    place = docs.columns.index("text")

    def give(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        old = batch.column(place).to_pylist()
        new = [_kept(*x).decode() if x[1].any() else t for t, x in zip(old, found)]
        return batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return _each(docs, keys, keep_first, give, docs.schema)
