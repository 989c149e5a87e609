import random

import duckdb
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmesh.llm import subwords as s
from rowmesh.llm import vocabularies

V = s.vocabulary()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=f"{vocabularies.FOLDER}/{vocabularies.PIECE_BPE}")


def plain_dropout(text, key, skip):
    """Merges by scanning all neighbours for the best candidate that isn't skipped, again and again."""
    parts = [(i, i + 1) for i in range(len(text))]
    base = s.xxhash.xxh32_intdigest(text.encode(), key)
    gone = set()
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, b), (_, c) = parts[k], parts[k + 1]
            r = V.order.get(text[a:c])
            if r is not None and (a, b, c) not in gone and (best is None or (r, a) < best[:2]):
                best = (r, a, b, c, k)
        if best is None:
            break
        _, a, b, c, k = best
        if s._skipped(base, a, b, c, skip):
            gone.add((a, b, c))
        else:
            parts[k : k + 2] = [(a, c)]
    out = []
    for a, b in parts:
        out += [V.ids[text[a:b]]] if text[a:b] in V.ids else V.fallback(text[a:b])
    return out


def samples():
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()
    return [r[0] for r in rows] + ["", " ", "  two  blanks ", "\n\n a\tb", "naïve 你好 🦊🦊", "<0x41><s></s><unk>", "x" * 3000, "aaaa bbbb" * 20]


def test_without_dropout_as_the_library():
    encoder = s.Encoder(V, 0.0)
    for text in samples():
        assert encoder.encode(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_agenda_against_scanning(dropout):
    rng = random.Random(3)
    words = [w for t in samples() for w in t.split()][:600]
    skip = round(dropout * 2**32)
    base = lambda w: s.xxhash.xxh32_intdigest(w.encode(), 7)
    chosen = [" " + rng.choice(words) for _ in range(150)] + [rng.choice(words) * rng.randrange(1, 12) for _ in range(40)]
    together = s.merged_together(V, chosen, s.np.array([base(w) for w in chosen], s.np.uint64), skip)
    for w, ids in zip(chosen, together):
        expected = plain_dropout(w, 7, skip)
        assert s._merged(V, w, base(w), skip) == expected
        assert ids is None or s.np.frombuffer(ids, s.np.uint16).tolist() == expected
    assert sum(ids is None for ids in together) < 5


def test_share_of_skipped_candidates():
    hit = sum(s._skipped(b * 2654435761 & 0xFFFFFFFF, i, i + 1 + b % 3, i + 4, round(0.1 * 2**32)) for b in range(2000) for i in range(20))
    assert 0.09 < hit / 40_000 < 0.11


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab<>0x\u0000"), st.characters(exclude_categories=("Cs",)))), st.sampled_from([0.0, 0.3, 1.0]), st.integers(0, 3))
def test_round_trip(text, dropout, variant):
    encoder = s.Encoder(V, dropout, key=5)
    ids = encoder.encode(text, variant)
    assert s.decode(V, ids) == text and encoder.encode(text, variant) == ids


def test_variants_differ_and_cost_more_tokens():
    text = " ".join(samples()[:20])
    none, some = s.Encoder(V, 0.0), s.Encoder(V, 0.1)
    ways = [some.encode(text, k) for k in range(4)] + [s.Encoder(V, 0.1, key=1).encode(text, 0)]
    assert len({tuple(w) for w in ways}) == 5
    assert all(len(none.encode(text)) < len(w) < 2 * len(none.encode(text)) for w in ways)
    assert all(s.decode(V, w) == text for w in ways)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(s, "REMEMBERED", 10)
    encoder, free = s.Encoder(V, 0.2), s.Encoder(V, 0.2)
    text = samples()[0]
    assert encoder.encode(text, 1) == free.encode(text, 1) and sum(map(len, [*encoder.young.values(), *encoder.old.values()])) <= 10


def test_long_texts_in_parts():
    text = "a  b\nccc  " * 400
    parts = list(s._parts(text, 100))
    assert "".join(parts) == text and len(parts) > 30
    assert [x for p in parts for x in V.stretch.findall(p)] == V.stretch.findall(text)


def test_queries(spark):
    rows = [(i, t) for i, t in enumerate(samples())] + [(3, None), (None, "a b"), (5, samples()[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("lang", F.lit("en"))
    got = s.encoded_digests(df).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    tokens = s.encoded(df, ("lang",))
    assert tokens.columns == ["doc_id", "lang", "variant", "ids"]
    assert sorted((r.doc_id or -1, len(r.ids)) for r in tokens.collect()) == sorted((r.doc_id or -1, r.n_tokens) for r in got)
    assert sorted((r.doc_id or -1, r.text) for r in s.decoded(tokens).collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert s.encoded_digests(df.limit(0)).count() == 0 and s.encoded(df.limit(0)).count() == 0


def test_dropout_differs_by_place_and_document():
    encoder = s.Encoder(V, 0.1)
    ways = set()
    for document in range(40):
        rest, found = encoder.encode("international " * 30, document), []
        assert s.decode(V, rest) == "international " * 30
        word = []
        for i in rest:
            if V.bytes[i].startswith(b" ") and word:
                found.append(tuple(word))
                word = []
            word.append(i)
        ways |= set(found)
        assert len(set(found)) > 1
    assert len(ways) > 4
    assert len({s.variant_of(i, s.VARIANTS) for i in range(100)}) == 100


def test_remembered_stretches_against_merging_each(monkeypatch):
    texts = [" ".join(samples()[:30]), *samples(), "a▁b ▁▁ " * 40]
    encoder = s.Encoder(V, 0.2, key=3)
    got = encoder.encode_all(texts, list(range(len(texts))))
    for variant, (text, ids) in enumerate(zip(texts, got)):
        expected, at = [], 0
        for part in V.stretch.findall(" " + text) if text else []:
            own = s.np.array([s.xxhash.xxh32_intdigest(part.encode())], s.np.uint64)
            key = s.np.array([s.xxhash.xxh32_intdigest(b"3 %d" % variant)], s.np.uint64)
            expected += s.np.frombuffer(encoder._stretch(part, int(s._bases(own, key, s.np.array([at]))[0])), s.np.uint16).tolist()
            at += len(part)
        assert ids.tolist() == expected
    monkeypatch.setattr(s, "PART", 300)
    assert [x.tolist() for x in s.Encoder(V, 0.2, key=3).encode_all(texts, list(range(len(texts))))] == [x.tolist() for x in got]


def test_every_pair_is_met_at_once():
    """meet() needs no search, and agrees with the pieces for pairs that make one, that make none, and that hold unknown symbols."""
    symbols = {k: x for x, k in zip(V.ids, range(len(V.ids)))}
    made = {(a, b): (c, V.order[symbols[c]]) for key, c in zip(V.pairs.tolist(), V.made.tolist()) if key >= 0 for a, b in [(key >> 32, key & 0xFFFFFFFF)]}
    assert len(made) > 50_000 and all(c in symbols for c, _ in made.values())
    assert all(symbols[a] + symbols[b] == symbols[c] for (a, b), (c, _) in made.items() if a in symbols and b in symbols)
    rng = s.np.random.default_rng(1)
    n = len(V.symbol_id)
    pairs = [*made, *map(tuple, rng.integers(-1, n, (20_000, 2)).tolist()), (-1, -1), (-1, 0), (0, -1)]
    a, b = s.np.array(pairs, s.np.int32).T
    which, order = V.meet(a, b)
    assert list(zip(which.tolist(), order.tolist())) == [made.get(p, (-1, int(s._LAST))) for p in pairs]


@pytest.mark.parametrize("n", [0, 1, 2, 37, 5000])
def test_slots_of_any_number_of_pairs(n):
    v = object.__new__(s.Vocabulary)
    keys = s.np.unique(s.np.random.default_rng(n).integers(0, 1 << 45, n))
    shift, at = v._slots(keys)
    assert len(set(at.tolist())) == len(keys) and (not n or at.max() < 1 << 64 - int(shift))


def test_what_is_remembered_is_not_walked_by_the_garbage_collector():
    import gc

    encoder = s.Encoder(V, 0.1)
    encoder.encode_all([t for t in samples()], list(range(len(samples()))))
    entries = list(encoder.young[0].values())
    assert len(entries) > 100 and not any(map(gc.is_tracked, entries))


def test_groups_of_any_size_give_the_same_ids(monkeypatch):
    """Remembered or new, alone or with others, in one group or many, with characters that no piece holds."""
    texts = samples() + ["a🦊b 🦊 ▁x", "▁", "word " * 50 + "y" * 60]
    one = [x.tolist() for x in s.Encoder(V, 0.3).encode_all(texts, list(range(len(texts))))]
    monkeypatch.setattr(s, "PART", 50)
    monkeypatch.setattr(s, "_TOGETHER", 7)
    monkeypatch.setattr(s, "REMEMBERED", 20)
    encoder = s.Encoder(V, 0.3)
    assert [encoder.encode(t, k) for k, t in enumerate(texts)] == one
