import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rowmesh.llm import warc

BIG = "<p>" + "ä" * 60 + "</p>"


def rows():
    return [
        (3, "http://a/3", BIG), (1, "http://a/1", BIG), (2, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "with\r\nWARC-Type: evil", "x" * 100),
        (9, "u", "x" * 100), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "ü", "\r\n\r\nWARC/1.1\r\n" * 20), (13, "u", "y" * 3_000_000), (14, "u", "z\u0000" * 80), (-5, "u", "x" * 100), (1, "http://a/1", BIG),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(3)


@pytest.fixture(scope="module")
def folder(pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write_pages(pages, path)
    return path


def expected():
    sets = {}
    for i, _, h in rows():
        sets.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows():
        data = (h or "").encode()
        first = min(x for x in sets[h or ""] if x is not None)
        again = len(data) >= 100 and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


KEY = lambda r: tuple((x is None, x) for x in r)


def test_round_trip(spark, folder):
    got = [tuple(r) for r in warc.read_back(spark, folder).collect()]
    assert sorted(got, key=KEY) == sorted(expected(), key=KEY)


def test_sql_gives_the_same(pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(warc.oracle()).fetchall(), key=KEY) == sorted(expected(), key=KEY)


def test_any_gzip_reader_can_read_it(spark, folder):
    import pathlib

    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(pathlib.Path(folder).glob("*.warc.gz")))
    assert text.count(b"WARC-Record-ID: <urn:page:") == len(rows())
    assert b"\r\nWARC-Type: evil" not in text


def test_payloads_that_are_not_wanted_stay_packed(folder, monkeypatch):
    inflated = []
    upto = warc._Member.upto
    monkeypatch.setattr(warc._Member, "upto", lambda self, done, step: (upto(self, done, step), inflated.append(len(self.data)))[0])
    reader = warc.WarcReader(folder, True)
    assert list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit")])) == []
    found = [r for p in reader.partitions() for r in warc.read_file(p.path, reader.wanted, True)]
    assert {r["warc_type"] for r in found} == {"revisit"} and max(inflated) < 70_000


@pytest.mark.parametrize(
    "condition",
    ["warc_type = 'response'", "target_uri like 'http://a/%'", "target_uri is null", "warc_type in ('revisit', 'x') and content_length > 10", "record_id = '<urn:page:4>' or payload_length = 0", "target_uri like '%/3' and payload_digest is not null", "warc_date >= '1970'"],
)
def test_predicates_give_the_same_as_without_pushdown(spark, folder, condition):
    warc.register(spark)
    pushed = spark.read.format("warc").load(folder).where(condition).collect()
    every = spark.createDataFrame(spark.read.format("warc").load(folder).collect(), warc.SCHEMA)
    plain = every.where(condition).collect()
    assert sorted(map(str, pushed)) == sorted(map(str, plain)) and pushed


def test_pushdown_is_in_the_plan(spark, folder, capsys):
    warc.register(spark)
    spark.read.format("warc").load(folder).where("warc_type = 'revisit'").explain("formatted")
    plan = capsys.readouterr().out
    assert "BatchScan" in plan and "Filter (" not in plan


def test_foreign_archives(spark, tmp_path):
    """Plain files, and members without a length in their header."""
    data = [warc.record("response", f"<urn:page:{i}>", f"http://x/{i}", "2020-01-01T00:00:00Z", "00", 5, b"hello") for i in range(4)]
    (tmp_path / "a.warc").write_bytes(data[0] + data[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[2]) + gzip.compress(data[3]))
    (tmp_path / "other.txt").write_text("x")
    warc.register(spark)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = spark.read.format("warc").load(path).collect()
        assert sorted(r.target_uri for r in got) == [f"http://x/{i}" for i in range(4)] and all(bytes(r.payload) == b"hello" for r in got)
    assert [r.record_id for r in spark.read.format("warc").load(str(tmp_path / "a.warc")).where("record_id = '<urn:page:1>'").collect()] == ["<urn:page:1>"]


def test_files_roll_over_and_uncommitted_ones_do_not_count(spark, pages, tmp_path):
    path = f"{tmp_path}/small"
    warc.register(spark)
    warc.page_records(pages).coalesce(1).write.format("warc").mode("append").option("path", path).option("rollBytes", "500").save()
    assert len(warc.WarcReader(path, True).partitions()) > 2
    (tmp_path / "small" / "part-9.warc.gz").write_bytes(b"torn")
    assert warc.read_back(spark, path).count() == len(rows())


def test_empty_table(spark, pages, tmp_path):
    warc.write_pages(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_back(spark, f"{tmp_path}/none").count() == 0
    assert warc.archived_pages(pages.withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1))).count() == len(rows())
