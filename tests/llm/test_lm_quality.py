"""The shipped settings on held-out documents, against counts of subwords and of pairs of them."""

import math
from collections import Counter

import duckdb
import numpy as np

from rowmesh.llm import lm, vocabularies

SF = "/root/testdata/sf0.01"


def test_model_beats_counts_of_subwords_and_of_pairs(spark):
    got = {r.doc_id: r for r in lm.scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    subwords = lm.Subwords(vocabularies.FOLDER, vocabularies.BYTE_BPE)
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    ids = dict(zip((i for i, _ in rows), subwords.texts([lm.text_bytes(t).lower().split() for _, t in rows])))
    end = subwords.encoding.n_vocab
    lines = {i: [end, *x.tolist(), end] for i, x in ids.items()}
    pairs, before, seen = Counter(), Counter(), Counter()
    for i, line in lines.items():
        if not got[i].held_out:
            pairs.update(zip(line, line[1:]))
            before.update(line[:-1])
            seen.update(line[1:])
    kinds, total = Counter(a for a, _ in pairs), sum(seen.values()) + end + 1
    single = double = n = 0
    for i, line in lines.items():
        if got[i].held_out:
            for a, b in zip(line, line[1:]):
                p = (seen[b] + 1) / total
                # Pairs are smoothed by how many kinds of subwords follow the first (Witten and Bell).
                share = kinds[a] / (before[a] + kinds[a]) if before[a] else 1.0
                single += math.log2(p)
                double += math.log2((1 - share) * (pairs[a, b] / before[a] if before[a] else 0) + share * p)
                n += 1
    bits = -sum(r.score for r in got.values() if r.held_out) * math.log2(10) / n
    assert bits < 0.85 * -single / n and bits < -double / n, (bits, -single / n, -double / n)
    assert np.isfinite(bits)
