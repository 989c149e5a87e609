"""Shared lines against a plain count over all documents."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from rowmesh.llm import bloom, line_dedup, queries

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def plain(rows, least, keep_first=False):
    """Each row's kept text, by counting documents and looking for first places."""
    n, first = Counter(), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            n[k] += 1
        for at, x in enumerate((text or "").split("\n")):
            here = (i is None, i or 0, at)
            first[key(x)] = min(here, first.get(key(x), here))
    gone = lambda i, at, x: key(x) and n[key(x)] >= least and not (keep_first and first[key(x)] == (i is None, i or 0, at))
    return ["\n".join(x for at, x in enumerate((t or "").split("\n")) if not gone(i, at, x)) for i, t in rows]


ODD = [(1, "Menu\nA\n menu \nMENU"), (2, None), (2, ""), (3, "menu\t\n\n\nb"), (None, "menu\nc"), (3, "menu\t\n\n\nb"), (4, "x\r\nmenu"), (5, "ÄMENU\nämenu"), (6, "Ämenu"), (7, "\n"), (8, "x"), (9, "line " * 50_000 + "\nx")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*x, f"own {k}") for k, x in enumerate(ODD)], "doc_id long, text string, h1 string").repartition(5)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("most", [line_dedup.MOST_KEYS, 0])
@pytest.mark.parametrize("bits", [None, 1 << 16])
def test_odd_documents(odd, keep_first, most, bits, monkeypatch):
    """Nulls, repeated rows, a long text, a clashing name; keys held or joined; a good filter and one of a single block."""
    monkeypatch.setattr(line_dedup, "MOST_KEYS", most)
    for least in (2, 3, 5):
        got = line_dedup.drop_repeated_lines(odd, least, keep_first, bits).collect()
        expected = {f"own {k}": t for k, t in enumerate(plain(ODD, least, keep_first))}
        assert {r.h1: r.text or "" for r in got} == expected and [r.text for r in got if r.h1 == "own 1"] == [None]
        assert {r.h1: r.doc_id for r in got} == {f"own {k}": i for k, (i, _) in enumerate(ODD)}


def test_empty_table_and_bad_number(odd):
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_keys(odd, 1)


def test_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(k, "same\nown" + str(k), "a", "b", "c") for k in range(12)], "doc_id long, text string, _t1 string, _T2 string, _keys string")
    line_dedup_most, line_dedup.MOST_KEYS = line_dedup.MOST_KEYS, 0
    try:
        got = line_dedup.drop_repeated_lines(docs)
        assert got.columns == docs.columns and {tuple(r)[1:] for r in got.collect()} == {(f"own{k}", "a", "b", "c") for k in range(12)}
    finally:
        line_dedup.MOST_KEYS = line_dedup_most


def test_filters_hold_what_came_twice(spark):
    """Over parts of any kind, what came twice in one or in two of them passes; of the rest nearly nothing does."""
    rng = np.random.default_rng(1)
    bits, some = 1 << 20, rng.integers(0, 2**64, 3000, np.uint64)
    dense = rng.integers(0, 2**64, 60_000, np.uint64)
    parts = [some[:1500], some[1000:2000], np.r_[some[2000:2200], some[2000:2200]], np.r_[some[2200:], dense]]
    rows = []
    for h in parts:
        seen = bloom.OnceTwice(bits)
        seen.add(h)
        rows += [tuple(r.values()) for batch in seen.blocks() for r in batch.to_pylist()]
    held = bloom.twice_filter(spark.createDataFrame(rows, "block int, once binary, twice binary"), bits)
    ok = bloom.passes(held, some)
    assert ok[1000:1500].all() and ok[2000:2200].all() and ok.mean() < 0.3 and bloom.passes(held, dense).mean() < 0.1
    table = spark.createDataFrame([(int(x),) for x in some.view(np.int64)], "h long")
    held = bloom.table_filter(table, "h", bits)
    assert bloom.passes(held, some).all() and bloom.passes(held, dense).mean() < 0.01


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = plain(rows, 10)
    shared = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    expected = []
    for (i, t), new in zip(rows, kept):
        lines = (t or "").split("\n")
        expected.append((i, len(lines), sum(bool(key(x)) and shared[key(x)] >= 10 for x in lines), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op12_line_dedup(spark, SF).collect())) == sorted(expected) and any(x[2] for x in expected)
