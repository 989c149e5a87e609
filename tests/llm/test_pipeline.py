import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from rowmesh.llm import pii, quality, subwords
from tests.llm.test_decontaminate import plain_tokens
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
GOOD = "Many quiet rivers run through old green valleys, and people who live there tell a@b.com long stories about winter, bread, horses and the sea beyond the hills."


def leaks(text, items):
    """Whether a text and an item share 12 aligned tokens with at most 2 substitutions."""
    x = plain_tokens(text)
    at = {}
    for k, w in enumerate(x):
        at.setdefault(w, []).append(k)
    for y in items:
        for shift in {k - j for j, w in enumerate(y) for k in at.get(w, ())}:
            same = [0 <= j + shift < len(x) and x[j + shift] == w for j, w in enumerate(y)]
            if any(sum(same[j : j + 12]) >= 10 for j in range(len(same) - 11)):
                return True
    return False


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on what the one before kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    frames = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == columns
        frames.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(frames[-1])
    good, single, clean, safe, ids = frames

    def keeps(r):
        counts = plain_counts(r.text)
        return counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0] and quality.in_band(quality.band_of(r.lang, r.text), quality.fertility(r.text))

    assert set(good) == {i for i, r in rows.items() if keeps(r)}
    order = sorted(good)
    roots = plain_components([plain_fingerprint(good[i].text) for i in order])
    assert set(single) == {order[k] for k in set(roots)}
    items = [plain_tokens(t) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    assert set(clean) == {i for i, r in single.items() if not leaks(r.text, items)}
    for i, r in clean.items():
        text = r.text
        for s, k, e in sorted(pii.find(text)[1], reverse=True):
            text = text[:s] + f"[{pii.KINDS[k].upper()}]" + text[e:]
        assert (safe[i].text, safe[i].n_chars, safe[i].lang, safe[i].source) == (text, len(text), r.lang, r.source)
    assert set(ids) == set(safe)
    encoder = subwords.Encoder(subwords.vocabulary())
    for i, r in ids.items():
        assert list(r.ids) == encoder.encode(safe[i].text, r.variant) and subwords.decode(encoder.v, r.ids) == safe[i].text
    # Planted labels: what is labelled good is lost only as a copy, a leak or by the base rules.
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()
    assert all(r.doc_id in good or plain_counts(rows[r.doc_id].text)[0] < 10 for r in labels if r.doc_id in rows)


def test_run_as_a_whole(spark):
    got = p.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "variant", "ids"] and got.count() > 0


@pytest.mark.parametrize("stage", [s for _, s in p.STAGES])
def test_empty_and_odd_documents(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, 0), (2, "a " * 100_000, "en", "s", 200_000), (2, "a " * 100_000, "en", "s", 200_000)], schema)
    stage(spark, odd, SF).collect()


def test_extra_columns_with_clashing_names(spark):
    """Columns of other names and of names that the operators use themselves go through all stages but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name in ("k1", "hs", "fp", "root", "item", "kept", "variant", "ids", "first", "row"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert all(r.fp == "own fp" and r.k1 == "own k1" for r in docs.select("fp", "k1").collect())
    assert p.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "lang", "source", "variant", "ids"]


def test_what_odd_documents_come_to(spark):
    long = " ".join(f"word{k}x{k * 7 % 1013}" for k in range(60_000))
    rows = [(1, None, None, None, None), (None, "", None, None, 0), (2, "a " * 100_000, "en", "s", 200_000), (3, long, None, "s", len(long)), (3, long, None, "s", len(long)), (None, GOOD, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.quality_rules(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in kept.collect()) in ([0], [0, 3, 3])
    assert sorted((r.doc_id or 0) for r in p.near_duplicates(spark, docs, SF).collect()) == [0, 1, 2, 3]
    assert p.decontamination(spark, docs, SF).count() == len(rows)
    safe = p.personal_data(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in safe) == sorted((i or 0, (t or "").replace("a@b.com", "[EMAIL]")) for i, t, *_ in rows)
    ids = p.tokens(spark, docs, SF).collect()
    assert sorted(len(r.ids) for r in ids)[:2] == [0, 0] and len(ids) == len(rows)


def test_columns_of_any_name_and_type(spark):
    """Names that stages make up, in other letters too, and maps, arrays and structs come out of every stage as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("text", F.concat(F.lit(GOOD + " "), F.col("text")))
    docs = docs.unionByName(docs.limit(3))
    for name in ("_rm_id", "_rm_text", "_rm_all", "_rm_k1", "_id", "_Text", "_all", "_n", "k1", "K2"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    key = F.col("doc_id").cast("string")
    docs = docs.withColumns({"m": F.create_map(key, F.lit(1), F.lit("z"), F.lit(2)), "a": F.array(F.create_map(key, F.lit(1))), "s": F.struct(F.create_map(F.lit("k"), F.map_from_arrays(F.array(key), F.array(key))).alias("deep"), key.alias("id"))})
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}{r.doc_id}" for c in ("_rm_id", "_rm_text", "_rm_all", "_rm_k1", "_id", "_Text", "_all", "_n", "k1", "K2"))
            assert r.m == {str(r.doc_id): 1, "z": 2} and r.a == [{str(r.doc_id): 1}] and r.s.deep == {"k": {str(r.doc_id): str(r.doc_id)}}
