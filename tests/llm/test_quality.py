import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rowmesh.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(11)
    parts = ["a", "b", "çé", "x|y", "##", "\n", "\n", "\t", "\x0b", " ", "  ", "\x85", " ", "\x1c", "w1", "w2"]
    return ["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "\n \n"]


def test_base_counts_against_the_definition():
    for text in texts():
        assert q.base_counts(text) == plain_counts(text), repr(text)


def test_many_words_as_numbers(monkeypatch):
    samples = [t.encode().split() for t in texts() if t]
    expected = [q.repeated_words(w) for w in samples]
    monkeypatch.setattr(q, "_MANY_WORDS", 5)
    assert [q.repeated_words(w) for w in samples] == expected


def test_fertility_against_counting():
    encoding, _ = q.vocabularies.byte_bpe()
    text = "The quick brown fox — naïve 你好 🦊 jumps. " * 3
    ids = encoding.encode_ordinary(text)
    n, chars, byte_share, entropy = q.fertility(text)
    assert n == len(ids) and chars == len(text) / n
    broken = 0
    for i in ids:
        try:
            encoding.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            broken += 1
    assert abs(byte_share - broken / n) < 1e-12
    import math

    assert abs(entropy + sum(c / n * math.log2(c / n) for c in Counter(ids).values())) < 1e-9
    assert q.fertility("") == (0, 0.0, 0.0, 0.0)


def test_pieces_keep_the_text_and_its_tokens():
    text = "".join(f"word{i % 91} " for i in range(4000))
    assert "".join(q.pieces(text, 500)) == text
    encoding, _ = q.vocabularies.byte_bpe()
    assert [t for p in q.pieces(text, 500) for t in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_verdicts(spark):
    clean = "Many quiet rivers run through old green valleys, and people who live there tell long stories about winter, bread, horses and the sea beyond the hills."
    rows = [
        (1, clean, "en"), (2, clean, None), (3, None, "en"), (4, "", None), (5, "too short", "en"), (6, "one two three four five " * 20, "en"),
        (7, "�ༀሀ⠀ꀀ " * 30 + "a b c d e f g h i j k l m n o p", "en"), (8, "你好世界，今天我们去山上看风景，明天再去海边 散步 然后 一起 吃饭 聊天 直到 夜深 才 回家 休息 做梦", None), (1, clean, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    got = q.quality(df).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True)]
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 8]
    assert q.quality(df.limit(0)).count() == 0 and q.quality(df.drop("lang")).count() == len(rows)


def test_pieces_of_the_second_vocabulary():
    model, byte_pieces = q.vocabularies.piece_bpe()
    text = "The quick brown fox — naïve 你好 🦊 jumps. " * 3
    ids = model.encode(text)
    found = q.fertility(text)
    assert tuple(found.pieces)[:2] == (len(ids), len(text) / len(ids)) and found.pieces.top == max(Counter(ids).values())
    assert abs(found.pieces[2] - sum(model.id_to_piece(i).startswith("<0x") for i in ids) / len(ids)) < 1e-12 and found.pieces[2] > 0 and byte_pieces.sum() == 256


def test_labelled_documents():
    """Bands were narrowed on labelled documents of even id, after a look at the spread of all; those of odd id show what they do."""
    import duckdb

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select text, lang, quality from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) where doc_id % 2 = 1").fetchall()
    kept = {0: [], 1: []}
    for text, lang, label in rows:
        counts = q.base_counts(text)
        kept[label].append(not q.base_failed(counts[0], counts[4]) and q.in_band(q.band_of(lang, text), q.fertility(text or "")))
    assert len(kept[0]) > 200 and sum(kept[0]) < 0.05 * len(kept[0]) and sum(kept[1]) > 0.97 * len(kept[1])
