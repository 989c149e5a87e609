import random

import xxhash
from pyspark.sql import functions as F

from rowmesh.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, threshold=3):
    """{row: root row} over a list of fingerprints, all pairs compared."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    out = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([4, 40, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            out.append("\n".join(base) if rng.random() < 0.2 else " ".join(base).upper().replace("É", "é"))
    return out + ["", None, " \t", "one", "One two", "one two", "x " * 5000, "x " * 5000]


def test_fingerprint_is_xxh64_majority(spark):
    for text in texts():
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    # Spark's own hash is the same function.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_long_text_in_pieces(monkeypatch):
    import rowmesh.llm.common as common

    whole = common.word_chunks
    text = " ".join(f"word{i % 977}" for i in range(5000))
    expected = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_chunks", lambda data: whole(data, 100))
    assert simhash.fingerprint(text) == expected == plain_fingerprint(text)


def test_components_against_all_pairs(spark):
    rows = [(i * 3 % 257, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit("clash"))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_components(df).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (doc, _), r in zip(rows, roots):
        least[r] = min(doc, least.get(r, doc))
    assert got == {(doc, f"{fp:016x}", least[r]) for (doc, _), fp, r in zip(rows, fps, roots)}


def test_dense_group_is_split_without_losing_links(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        x = rng.choice(sorted(fps))
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for part in (7, 50, 2048):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, part).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        assert [find(x) for x in fps] == [fps[i] for i in plain_components(fps)]


def test_one_document_of_each_component_stays(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (9, "q r s t u v"), (None, "z y x w v"), (None, "z y x w v"), (1, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_rm", F.lit(1))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "z y x w v"), (1, ""), (3, "a b c d e"), (9, "q r s t u v")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_components(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_what_grows_with_documents_is_not_broadcast(spark):
    """However small Spark takes the tables to be: it sizes a fingerprint's 30 points as one, and a table of all documents by its file."""
    fps = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1
    keyed = fps.withColumn("doc_id", F.monotonically_increasing_id())
    plan = simhash.components(keyed)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join" in line)
