"""The registered queries on the small tables, against plain versions of their contracts."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rowmesh.llm import subwords
from tests.llm.slow_html import slow_text
from tests.llm import test_decontaminate, test_html_text, test_lm, test_pii, test_quality, test_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: __spark_entry__.queries()[name](spark, SF).collect()


def test_all_are_registered():
    names = __spark_entry__.queries().keys()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_op1(rows, docs):
    got = {r.doc_id: r for r in rows("op1_pii")}
    assert len(got) == len(docs)
    for i, text in docs:
        base = test_pii.plain(text or "")
        joined = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_op2(rows, docs):
    got = rows("op2_sharding")
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs]
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(k, n) for k in range(8) for n in range(sizes[k])}


def test_op3(rows, docs):
    got = {r.doc_id: r for r in rows("op3_quality")}
    assert len(got) == len(docs)
    for i, text in docs:
        r, counts = got[i], test_quality.plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and not (r.base_failed and r.kept)


def test_op4(rows, docs):
    got = {r.doc_id: r for r in rows("op4_lm")}
    assert len(got) == len(docs)
    for expected in test_lm.plain_base(docs):
        r = got[expected[0]]
        assert tuple(r)[:5] == expected[:5] and np.isclose(r.base_score, expected[5], rtol=1e-9) and r.score < 0


def test_op5(rows, docs):
    fps = [test_simhash.plain_fingerprint(t) for _, t in docs]
    roots = test_simhash.plain_components(fps)
    least = {}
    for (i, _), r in zip(docs, roots):
        least[r] = min(i, least.get(r, i))
    assert sorted(tuple(r) for r in rows("op5_simhash")) == sorted((i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(docs, fps, roots))


def test_op6(rows):
    got = {r.page_id: r for r in rows("op6_html")}
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    assert {i: (r.url, r.text, r.n_chars) for i, r in got.items()} == {i: (u, test_html_text.main_text(h), len(test_html_text.main_text(h))) for i, u, h in pages}
    assert {i: r.text for i, r in got.items()} == {i: slow_text(h) for i, _, h in pages}


def test_op7(rows, docs):
    got = {r.doc_id: r for r in rows("op7_subwords")}
    encoder = subwords.Encoder(subwords.vocabulary())
    # A key for each document; when this was written there were four keys in all, and all four were asked for.
    assert len(got) == len(docs) and {i: r.variant for i, r in got.items()} == {i: subwords.variant_of(i, subwords.VARIANTS) for i in got}
    for i, text in docs:
        ids = encoder.encode(text, got[i].variant)
        assert got[i].lossless and (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))


@pytest.mark.parametrize("name", sorted(__spark_entry__.corpus_queries.oracle_sql()))
def test_with_sql(rows, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows(name)), key=key) == sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall(), key=key)


def test_op10(rows, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    # Alignments are tried only where a text and an item share some four tokens in a row.
    grams = {}
    for j, b in items:
        y = test_decontaminate.plain_tokens(b)
        for k in range(len(y) - 3):
            grams.setdefault(tuple(y[k : k + 4]), set()).add(j)
    expected = {}
    for i, a in docs:
        x = test_decontaminate.plain_tokens(a)
        near = set().union(*(grams.get(tuple(x[k : k + 4]), set()) for k in range(len(x) - 3)))
        for j in near:
            y = test_decontaminate.plain_tokens(dict(items)[j])
            at = {}
            for k, w in enumerate(x):
                at.setdefault(w, []).append(k)
            for shift in {k - m for m, w in enumerate(y) for k in at.get(w, ())}:
                lo, hi = max(0, shift), min(len(x), shift + len(y))
                equal = np.array([x[k] == y[k - shift] for k in range(lo, hi)])
                if equal.sum() >= 10:
                    s, e = test_decontaminate.d.longest(equal)
                    if e - s >= 12:
                        expected[i, j] = max(expected.get((i, j), 0), e - s)
    assert {(r.doc_id, r.item_id): r.overlap_tokens for r in rows("op10_decontamination")} == expected and expected


def test_settings_stay_as_they_are(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    for name in ("op1_pii", "op2_sharding", "op3_quality", "op6_html", "op7_subwords", "op8_warc", "op9_urls", "op10_decontamination"):
        assert __spark_entry__.queries()[name](spark, SF).columns
    assert [spark.conf.get(n) for n in names] == before
