"""Ranked search against scores of all pairs, and trees against plain products."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowmesh.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, best=50):
    tfs = [Counter(plain_terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    n_docs, all_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for (doc_id, _), tf, n in zip(docs, tfs, sizes):
            m = 50 + 50 * n * n_docs // all_terms if all_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(plain_terms(text)) if tf[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if no else d, -s) for k, (s, no, d) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, " \x00!"), (None, "red Fox"), (None, "red fox"), (4, "RED fox fox"), (4, "RED fox fox"), (5, "ÄPFEL äpfel red" + " x" * 300_000), (6, "re-d f_o_x 7seven"), (7, "red\x7ffox"), (8, "naïve – x")]
    items = [(0, "red fox"), (0, "red fox"), (0, "äpfel"), (1, None), (2, ""), (3, "!!"), (4, "unseen"), (None, "7seven F"), (5, "ÄPFEL"), (6, "x Naïve")]
    d = spark.createDataFrame([(*x, k) for k, x in enumerate(docs)], "doc_id long, text string, score int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for best in (50, 2):
        assert sorted(map(tuple, lexical.search(d, i, best).collect()), key=str) == plain_search(docs, items, best)
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("docs,block", [(lexical.TREE_DOCS, lexical.BLOCK_BYTES), (64, 60)])
def test_many_trees_and_blocks(spark, docs, block, monkeypatch):
    """Long slices and short ones, queries at once and in blocks; many equal scores."""
    monkeypatch.setattr(lexical, "TREE_DOCS", docs)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(40, 0, -1) / 820))
    rows = [(k, text(int(rng.integers(1, 30)))) for k in range(600)] + [(1000 + k, "w1 w2 w39") for k in range(80)]
    items = [(k, text(8)) for k in range(12)]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 60), st.integers(1, 20))
def test_tree_is_exact(seed, n, width, k):
    """Any vectors, large values too: the k best by whole-number products, ties by id; far subtrees are left alone."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, width + 1, n)
    cols = np.concatenate([rng.choice(width, s, replace=False) for s in sizes])
    vals = rng.integers(1, 10**6, len(cols))
    ptr, ids = np.r_[0, np.cumsum(sizes)], rng.integers(-50, 1000, n)
    tree = lexical.Tree(ids, np.zeros(n, bool), ptr, cols, vals)
    q = np.sort(rng.choice(width + 5, min(width, 6), replace=False))
    w = rng.integers(-3, 25_000, len(q))
    best = []
    tree.search(q, w, best, k)
    of = dict(zip(q.tolist(), w.tolist()))
    scores = [(sum(of.get(c, 0) * v for c, v in zip(cols[a:b].tolist(), vals[a:b].tolist())), True, -i) for a, b, i in zip(ptr, ptr[1:], ids.tolist())]
    assert sorted(best, reverse=True) == sorted((s for s in scores if s[0] > 0), reverse=True)[:k]


def test_far_subtrees_stay_closed():
    """Groups on terms of their own: a query for one group opens few leaves of the others."""
    n, group = 4096, 64
    cols = np.repeat(np.arange(n) // group, 2) * 2 + np.tile([0, 1], n)
    tree = lexical.Tree(np.arange(n), np.zeros(n, bool), np.arange(0, 2 * n + 1, 2), cols, np.random.default_rng(0).integers(900, 1000, 2 * n))
    best = []
    opened = tree.search(np.array([20, 21]), np.array([1000, 1000]), best, 50)
    assert len(best) == 50 and all(640 <= -b[2] < 704 for b in best)
    assert opened <= 20 and sum(k is None for k in tree.kids) >= 64
