"""Ranked lexical search: exact greatest inner products by ball trees over sparse term vectors.

A document's vector has, for each term that some query holds, a whole number made of
the term's count there and the document's length; a query's vector has the weights of
its terms. Tasks build trees over slices of their documents: a node keeps the centroid
and the radius of the vectors under it, so no document there can score more than the
centroid does plus radius times the query's length. Subtrees are opened best-first
and left alone once this bound, rounded up, is below the query's 50th best score; at
leaves scores are whole numbers, exactly. Each task hands on its best documents of
each query, and the best of these are the result.

Queries come in blocks of bounded size. Counts of terms are taken of all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_bytes, word_chunks, written

#: Documents that a query returns.
BEST = 50
#: Bytes of query texts in one block (a single longer one is a block of its own); their terms go to every task.
BLOCK_BYTES = 8 << 20
#: Documents, and entries of their vectors, that one tree holds, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 1 << 14, 1 << 21, 48
#: What a bound is raised by: far more than sums of doubles can be off by.
_SLACK = 1e-9
# Bytes that are part of a term; A-Z are lower-cased, all others part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_chunks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    return word_chunks(text.translate(_FOLD))


def length_part(n, n_docs: int, all_terms: int):
    """A document's m by its number of terms."""
    return 100 - 50 + (50 * n * n_docs) // all_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Tree:
    """A ball tree over sparse rows: doc_ids, and entries (column, value) of row k at ptr[k] to ptr[k + 1]."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.used, local = np.unique(cols, return_inverse=True)
        self.doc_ids, self.nulls, self.ptr, self.cols, self.vals = doc_ids, nulls, ptr, local, vals
        self.real, self.norm = vals.astype(float), self._sums(vals.astype(float) ** 2, ptr)
        self.radius: list[float] = []
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        centers: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = [(np.arange(len(doc_ids)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            node = len(self.kids)
            self.kids.append(None)
            self.rows.append(rows)
            if parent >= 0:
                self.kids[parent] = (node, self.kids[parent][1]) if side == 0 else (self.kids[parent][0], node)
            entries, upto = self._entries(rows)
            c, v = local[entries], self.real[entries]
            center = np.bincount(c, v, len(self.used)) / len(rows)
            square = float(center @ center)
            away = self.norm[rows] - 2 * self._sums(v * center[c], upto) + square
            self.radius.append(math.sqrt(max(0.0, float(away.max())) + _SLACK * (float(self.norm[rows].max()) + square)))
            seen = np.flatnonzero(center)
            centers.append((seen, center[seen]))
            if len(rows) > LEAF:
                half = np.argpartition(self._along(c, v, upto, center), len(rows) // 2)
                self.kids[node] = (-1, -1)
                waiting += [(rows[half[len(rows) // 2 :]], node, 0), (rows[half[: len(rows) // 2]], node, 1)]
        # Centroids by column, to be met by the few columns of a query.
        which = np.repeat(np.arange(len(centers)), [len(s) for s, _ in centers])
        columns, values = (np.concatenate(x) for x in zip(*centers))
        order = np.argsort(columns, kind="stable")
        self.center_node, self.center_value = which[order], values[order]
        self.center_ptr = np.searchsorted(columns[order], np.arange(len(self.used) + 1))
        self.ball = np.array(self.radius)

    @staticmethod
    def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Sums of each row's values; every row has some."""
        return np.add.reduceat(values, upto[:-1])

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.ptr[rows + 1] - self.ptr[rows]
        upto = np.r_[0, np.cumsum(n)]
        return np.arange(upto[-1]) + np.repeat(self.ptr[rows] - upto[:-1], n), upto

    def _along(self, c: np.ndarray, v: np.ndarray, upto: np.ndarray, center: np.ndarray) -> np.ndarray:
        """Each row's place along a direction in which the rows differ much: two steps of the power method from a fixed random start. Rows that are alike have places that are."""
        direction = np.random.default_rng(len(c)).standard_normal(len(center))
        for step in range(3):
            direction /= max(math.sqrt(float(direction @ direction)), 1e-300)
            places = self._sums(v * direction[c], upto) - float(center @ direction)
            if step < 2:
                direction = np.bincount(c, v * np.repeat(places, np.diff(upto)), len(center)) - center * places.sum()
        return places

    def search(self, cols: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> int:
        """Put what belongs among the k best into `best`, a heap of (score, has an id, -doc_id); the number of leaves looked at."""
        at = np.searchsorted(self.used, cols)
        at = np.minimum(at, len(self.used) - 1)
        have = self.used[at] == cols
        at, weights = at[have], weights[have]
        if not len(at):
            return 0
        query = np.zeros(len(self.used), np.int64)
        query[at] = weights
        lo, hi = self.center_ptr[at], self.center_ptr[at + 1]
        n = hi - lo
        where = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        center = np.bincount(self.center_node[where], self.center_value[where] * np.repeat(weights.astype(float), n), len(self.ball))
        bound = ((center + math.sqrt(float((weights.astype(float) ** 2).sum())) * self.ball) * (1 + _SLACK) + 1).tolist()
        opened, waiting = 0, [(-bound[0], 0)]
        while waiting:
            most, node = heapq.heappop(waiting)
            if len(best) == k and -most < best[0][0] or -most < 1:
                break
            if (kids := self.kids[node]) is not None:
                for kid in kids:
                    heapq.heappush(waiting, (max(most, -bound[kid]), kid))
                continue
            opened += 1
            rows = self.rows[node]
            entries, upto = self._entries(rows)
            scores = self._sums(query[self.cols[entries]] * self.vals[entries], upto)
            least = best[0][0] if len(best) == k else 1
            for r in np.flatnonzero(scores >= max(least, 1)).tolist():
                found = (int(scores[r]), not self.nulls[rows[r]], -int(self.doc_ids[rows[r]]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return opened


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each document, and how often it has those of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in small(batches):
            sizes, terms, counts, upto = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                n, found = 0, Counter()
                for words in term_chunks(text_bytes(text)):
                    n += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                sizes.append(n)
                terms += found
                counts += found.values()
                upto.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n long, terms array<int>, counts array<long>")


def _best(counted: DataFrame, queries: list[tuple[int, int | None, np.ndarray, np.ndarray]], n_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best documents of each query."""
    sent = counted.sparkSession.sparkContext.broadcast(queries)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in sent.value]
        held: list[pa.RecordBatch] = []

        def look() -> None:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            terms, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks()
            ptr = np.asarray(terms.offsets).astype(np.int64)
            ids, tf = t["doc_id"].combine_chunks(), counts.flatten().to_numpy()
            m = np.repeat(length_part(t["n"].to_numpy(), n_docs, all_terms), np.diff(ptr))
            vals = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
            tree = Tree(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ptr - ptr[0], terms.flatten().to_numpy().astype(np.int64), vals)
            for mine, (_, _, cols, weights) in zip(best, sent.value):
                tree.search(cols, weights, mine, k)

        rows = entries = 0
        for batch in small(batches, 1024):
            held.append(batch)
            rows, entries = rows + batch.num_rows, entries + len(batch.column(2).flatten())
            if rows >= TREE_DOCS or entries >= TREE_ENTRIES:
                look()
                rows = entries = 0
        look()
        for (item, item_id, _, _), mine in zip(sent.value, best):
            if mine:
                score, has, doc = zip(*mine)
                ids = pa.array([-d if h else None for h, d in zip(has, doc)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(mine), pa.int64()), pa.array([item_id] * len(mine), pa.int64()), ids, pa.array(score, pa.int64())], ["item", "item_id", "doc_id", "score"])

    slim = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts")
    return slim.mapInArrow(each, "item long, item_id long, doc_id long, score long")


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of at most BLOCK_BYTES of text, or of one item."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        sizes = items.groupBy(block.alias("block")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("items"))
        if not sizes.where((F.col("bytes") > BLOCK_BYTES) & (F.col("items") > 1)).limit(1).count():
            return [items.where(block == k) for k in range(n)]
        n *= 2


def search(docs: DataFrame, benchmark: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` highest-scoring documents of each item with a score above 0.

    Of equal scores the least doc_id comes first, null last; every row of docs is a
    document of its own. Rows alike in item_id and text are one item; different texts
    under one item_id are ranked each by itself. A null text, or one without terms, is
    no document and no query. Texts are read whole; other columns don't matter. Empty
    tables give no rows.
    """
    texts = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = written(texts.withColumn("item", F.monotonically_increasing_id()), "queries")
    found = [_searched(docs, block, best) for block in _blocks(items)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _searched(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows = items.select("item", "item_id", "text").toArrow().to_pylist()
    terms = [set().union(*term_chunks(text_bytes(r["text"]))) for r in rows]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*terms)))}
    counted = written(_counted(docs, vocabulary), "term-counts")
    n_docs, all_terms = counted.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    df = {r.term: r.df for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    queries = []
    for r, mine in zip(rows, terms):
        cols = np.array(sorted(vocabulary[t] for t in mine if vocabulary[t] in df), np.int64)
        queries.append((r["item"], r["item_id"], cols, np.array([weight(df[c], n_docs) for c in cols.tolist()], np.int64)))
    return written(_best(counted, queries, n_docs or 0, all_terms or 1, k), "best")
