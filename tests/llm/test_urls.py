import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rowmesh.llm import urls


def test_terms_against_regular_expressions():
    rng = random.Random(2)
    terms = urls.automaton(urls.STRICT, urls.SOFT)
    parts = [*urls.STRICT[:6], *urls.SOFT[:8], ".", "-", "/", "a", "9", "é", ""]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        count = lambda words: sum(bool(re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", text)) for w in words)
        assert urls.hits(text, terms) == (count(urls.STRICT), count(urls.SOFT))


CASES = [
    ("https://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://casino.com/", "casino.com", "/", "com/", "allow"),
    ("http://casino.com", "casino.com", "", None, "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("x://a.net/es/5", "a.net", "/es/5", "net/es/", "block"),
    ("x://a.net/de/5", "a.net", "/de/5", None, "allow"),
    ("x://cheap-pills.org/", "cheap-pills.org", "/", None, "block"),
    ("x://free.org/BONUS", "free.org", "/BONUS", None, "block"),
    ("x://free.org/freedom?bonus", "free.org", "/freedom", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://?q", "", "", None, "allow"),
]


@pytest.fixture
def pages(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(0, CASES[0][0]), (None, "http://x.net/fr/"), (99, "http://h.org/" + "free/" * 20_000 + "bonus")]
    return spark.createDataFrame(rows, "page_id long, url string")


def test_verdicts(pages):
    got = urls.url_verdicts(pages.withColumn("host", F.lit("clash"))).collect()
    for r in got:
        if r.page_id is not None and r.page_id < len(CASES):
            assert (r.host, r.path, r.rule, r.verdict) == CASES[r.page_id][1:]
    assert len(got) == len(CASES) + 3 and next(r for r in got if r.page_id == 99).verdict == "block"
    assert urls.url_verdicts(pages.limit(0)).count() == 0


def test_sql_gives_the_same(pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    rows = con.sql(urls.oracle()).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows, key=key) == sorted((tuple(r) for r in urls.url_verdicts(pages).collect()), key=key)


def test_terms_in_the_whole_url(spark, tmp_path):
    cases = [("http://h.org/go?to=casino-porn", "block"), ("www.casino.net/xxx", "block"), ("x://free.org/freedom?BONUS", "block"), ("x://free.org/freedom#bonuses", "allow"), ("http://casino.com/?xxx", "allow"), (None, "allow"), ("", "allow"), ("http://a.net/es/?free", "block")]
    pages = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "page_id long, url string")
    rows = {r.page_id: r for r in urls.url_verdicts(pages, whole=True).collect()}
    assert [rows[i].verdict for i in range(len(cases))] == [c[1] for c in cases]
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(urls.oracle(whole=True)).fetchall()) == sorted(map(tuple, rows.values()))
    (tmp_path / "terms").write_text("# mine\nRivers\n\nstones\nrivers\n")
    assert urls.terms_of(str(tmp_path / "terms")) == ("rivers", "stones")
    own = urls.url_verdicts(spark.createDataFrame([(1, "http://x.org/rivers")], "page_id long, url string"), strict=urls.terms_of(str(tmp_path / "terms")), soft=())
    assert own.first().verdict == "block"
