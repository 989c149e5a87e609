"""Runs of words against all starts and periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmesh.llm import periodic_runs as r

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs, from equal words at every distance."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= 2 * q and (s, length) not in found:
                found[s, length] = q
            s = e + 1
    return sorted((s, n_, q) for (s, n_), q in found.items() if n_ >= max(12, 2 * q))


def plain_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept), len(words), len(gone)


def found_runs(words):
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return [tuple(x) for x in r.word_runs(ids, np.zeros(len(ids), np.int64)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_any_sequence(words):
    assert found_runs(words) == plain_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 6)), max_size=8))
def test_repeats_of_repeats(parts):
    words = [w for part, n in parts for w in part * n]
    assert found_runs(words) == plain_runs(words)


def test_known_sequences():
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    for words in (fib[-1], "a" * 500, "ab" * 100 + "a", "abc" * 4, "abc" * 3 + "ab", "aab" * 40 + "aac" * 40, ("a" * 7 + "b") * 9):
        assert found_runs(list(words)) == plain_runs(list(words))
    assert found_runs(list("abcabcabcab")) == [] and found_runs(list("abcabcabcabc")) == [(0, 12, 3)]


def test_texts_side_by_side_stay_apart():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)] + ["x y " * 20] * 5
    w, rows, cuts, kept, kept_cuts = r._slice([None] * len(texts), [t.encode() for t in texts], True)
    for k, t in enumerate(texts):
        assert [(a - w.first[k], b, c) for a, b, c in rows[cuts[k] : cuts[k + 1]].tolist()] == plain_runs(t.split())


@pytest.mark.parametrize("table", ["documents"])
def test_query(spark, table):
    from rowmesh.llm import queries

    rows = spark.read.parquet(f"{SF}/{table}.parquet").collect()
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, SF).collect()))
    assert got == sorted(plain_row(x.doc_id, x.text) for x in rows) and any(x[1] for x in got)


def test_odd_documents(spark):
    long = " ".join(f"w{k}" for k in range(40_000)) + " x y z" * 2_000
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \n\t "), (4, "a\x0bb\x0c" * 20), (4, "a\x0bb\x0c" * 20), (5, "ä é " * 9), (20, "one two three " * 5), (6, "    " * 10)]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, n_runs int")
    order = lambda x: (x[0] is None, *map(str, x))
    for plant in (False, True):
        got = r.periodic_runs(docs, plant).collect()
        expected = [plain_row(i, t) if plant or i is None or zlib.crc32(str(i).encode()) % 10 else (i, *plain_row(None, t)[1:]) for i, t in rows]
        assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    one = r.periodic_runs(spark.createDataFrame([(None, long)], "doc_id long, text string")).first()
    assert (one.n_runs, one.start, one.length, one.period, one.n_dropped) == (1, 40_000, 6_000, 3, 5_997)
    assert r.periodic_runs(docs.limit(0)).count() == 0


def test_collapsed(spark):
    rows = [(1, "keep  this\n as it is", "a"), (2, "go now " * 8 + "and\nstop", "b"), (3, None, None), (4, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {x.doc_id: x.text for x in r.collapsed(docs).collect()}
    assert got == {1: rows[0][1], 2: "go now and stop", 3: None, 4: ""}
    assert r.collapsed(docs.withColumn("more", F.lit(1))).columns == [*docs.columns, "more"]
