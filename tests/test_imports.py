"""Payloads in pages, their source, imports end to end, tables over JDBC, and ranges of files."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from codexa.operators import media, sync
from codexa.sources.media import file_stats
from codexa.sources.pages import fetch_pages
from codexa.sources.payload import jdbc_table, json_rows, read_pages, write_pages
from codexa.sources.tables import CONTENT, schema

EN, DE = {"alias": "en", "name_en": "E", "name_national": "E"}, {"alias": "de", "name_en": "D", "name_national": "D"}


def pages(tmp_path, *lines, name="p"):
    (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(x) for x in lines))
    return f"file://{tmp_path}/{name}.json"


def test_whole_document_and_types(spark, tmp_path):
    path = tmp_path / "whole.json"
    path.write_text(json.dumps({"languages": [EN], "voices": [], "translations": [{"code": 1, "alias": "t"}], "other": [1]}, indent=1))
    got = read_pages(spark, f"file://{path}", whole=True)
    assert set(got) == {"languages", "translations"}
    assert [r.json for r in json_rows(got["translations"].drop("_place")).collect()] == ['{"code":1,"alias":"t","name":null,"description":null,"language":null,"active":null}']
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CANNOT_PARSE"):
        read_pages(spark, pages(tmp_path, {"translations": [{"code": "x", "alias": "t"}]}, name="bad"))["translations"].collect()


def test_columns_follow_the_first_row(spark, tmp_path):
    first = {"code": 1, "alias": "a", "language": "en"}
    got = read_pages(spark, pages(tmp_path, {"page": 2, "translations": [{"code": 3, "alias": "c", "language": None, "name": "left out"}]}, {"page": 1, "translations": [first, {"language": "de", "alias": "b", "code": 2}]}))
    assert [(r.code, r.alias, r.name, r.language) for r in got["translations"].orderBy("_place").collect()] == [(1, "a", None, "en"), (2, "b", None, "de"), (3, "c", None, None)]
    with pytest.raises(Exception, match="a row of translations lacks language"):
        read_pages(spark, pages(tmp_path, {"translations": [first, {"code": 2, "alias": "b"}]}, name="lacking"))["translations"].collect()
    with pytest.raises(ValueError, match="translations has no column odd"):
        read_pages(spark, pages(tmp_path, {"translations": [first | {"odd": 1}]}, name="odd"))
    with pytest.raises(ValueError, match="languages needs name_national"):
        read_pages(spark, pages(tmp_path, {"languages": [{"alias": "x", "name_en": "X"}]}, name="needs"))
    assert read_pages(spark, pages(tmp_path, {"page": 1}, name="none")) == {}


def test_pages_that_were_written_are_read(spark, tmp_path):
    df = spark.createDataFrame([(f"l{i}", f"say \"{i}\"\n", "ü") for i in range(25)], schema("languages")).repartition(3)
    write_pages({"languages": [df, df.withColumn("name_en", F.lit("second"))]}, f"file://{tmp_path}/w", rows=4)
    got = read_pages(spark, f"file://{tmp_path}/w")["languages"]
    assert sorted(map(tuple, got.where("name_en <> 'second'").drop("_place").collect())) == sorted(map(tuple, df.collect()))
    assert got.agg(F.max_by("name_en", "_place")).first()[0] == "second" and got.select("_place").distinct().count() == 50
    assert got.agg(F.max("_place.position")).first()[0] == 3


def test_pages_are_small_and_made_without_a_shuffle(spark, tmp_path):
    """Rows of one verse that differ by their voice take a few bytes each, and a table's pages are found by its folder."""
    rows = spark.range(0, 200_000, numPartitions=3).selectExpr("id % 50 AS voice", "1 AS book_number", "cast(id / 5000 AS int) AS chapter_number", "cast(id / 50 AS int) % 100 AS verse_number", "id / 50 * 4.0D AS begin", "cast(NULL AS double) AS end")
    languages = spark.createDataFrame([("x", "X", "x")], schema("languages"))
    spark.sparkContext.setJobGroup("pages", "")
    write_pages({"voice_alignments": [rows], "languages": [languages]}, f"file://{tmp_path}/w")
    tracker = spark.sparkContext.statusTracker()
    shuffled = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("pages")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(shuffled) == {1} and sum(f.stat().st_size for f in (tmp_path / "w").rglob("part-*")) < 15 * 200_000
    got = read_pages(spark, f"file://{tmp_path}/w")
    assert got["voice_alignments"].drop("_place").exceptAll(rows).count() == 0 and got["voice_alignments"].select("_place").distinct().count() == 200_000
    assert got["languages"].count() == 1


def test_imports_end_to_end(spark, tmp_path):
    """Rows are counted as they are written; of a repeated key the last counts; what fails half way changes nothing."""
    store = f"file://{tmp_path}/store"
    all_of = lambda t: sorted(map(str, sync.published(spark, store)[t].collect()))
    assert all(all_of(t) == [] for t in CONTENT)
    full = pages(tmp_path, {"languages": [EN, DE], "translations": [{"code": 1, "alias": "one"}, {"code": 2, "alias": "two"}]}, name="full")
    assert sync.run_import(spark, read_pages(spark, full), store) == {t: 2 if t in ("languages", "translations") else 0 for t in CONTENT}
    part = pages(
        tmp_path,
        {"page": 1, "languages": [EN | {"name_en": "first"}, EN | {"name_en": "between"}], "translations": [{"code": 2, "alias": "new"}, {"code": 1, "alias": "beside"}]},
        {"page": 2, "languages": [EN | {"name_en": "last"}]}, name="part",
    )
    done = sync.run_import(spark, read_pages(spark, part), store, partial=True)
    assert done["languages"] == 3 and done["translations"] == 2
    now = sync.published(spark, store)
    assert {r.alias: r.name_en for r in now["languages"].collect()} == {"en": "last", "de": "D"}
    assert sorted((r.code, r.alias) for r in now["translations"].collect()) == [(1, "beside"), (1, "one"), (2, "new")]  # the scope is that of the first row, not of the smallest code
    before = {t: all_of(t) for t in CONTENT}
    voice = {"code": 1, "alias": "v", "name": "n"}
    broken = pages(tmp_path, {"languages": [DE | {"name_en": "no"}], "translations": [{"code": 1, "alias": "no"}], "voices": [voice, {"code": 2, "alias": "w"}]}, name="broken")
    with pytest.raises(Exception, match="a row of voices lacks name"):
        sync.run_import(spark, read_pages(spark, broken), store, partial=True)
    assert {t: all_of(t) for t in CONTENT} == before
    with pytest.raises(ValueError, match="no translation"):
        sync.run_import(spark, read_pages(spark, pages(tmp_path, {"languages": [EN]}, name="without")), store, partial=True)
    assert {t: all_of(t) for t in CONTENT} == before


def test_two_that_publish_at_once(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    one = {"languages": spark.createDataFrame([("en", "E", "E")], schema("languages"))}
    sync.publish(one, store)
    monkeypatch.setattr(sync, "_current", lambda *_: (0, None))  # what a second publisher saw before the first was done
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sync.publish(one, store)


@pytest.fixture
def service():
    """A content service that knows two translations; what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = parse_qs(urlsplit(self.path).query).get("translation", [None])[0]
            asked.append((name, self.headers["X-API-Key"]))
            known = {"a b": 1, "two": 2}.get(name)
            self.send_response(200 if known else 503)
            self.end_headers()
            rows = [{"code": 1000 * (known or 0) + i, "translation": known, "book_number": i, "name": "ä"} for i in range(6000)]
            self.wfile.write(json.dumps({"translation_books": rows, "languages": [EN], "unknown": [1]}).encode() if known else b"x" * 900)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_payload_source(spark, service, tmp_path):
    url, asked = service
    found = fetch_pages(spark, url, f"file://{tmp_path}/in", ["a b", "two"], "k")
    assert {r.translation: r.pages for r in found.collect()} == {"a b": 3, "two": 3} and sorted(asked) == [("a b", "k"), ("two", "k")]
    assert spark.read.format("payload_pages").options(url=url, translations='["a b", "two"]').load().rdd.getNumPartitions() == 2
    got = read_pages(spark, f"file://{tmp_path}/in")
    books = got["translation_books"].orderBy("_place").collect()
    assert len(books) == 12000 and [books[i].code for i in (0, 5999, 6000, 11999)] == [1000, 6999, 2000, 7999] and got["languages"].count() == 2
    with pytest.raises(Exception, match="the source answered 503: x{500}\n"):
        fetch_pages(spark, url, f"file://{tmp_path}/bad", ["none"])
    assert not (tmp_path / "bad").exists()
    with pytest.raises(Exception, match="option url is needed"):
        spark.read.format("payload_pages").load().collect()


def test_tables_over_jdbc(spark, tmp_path):
    """Ranges of the key, in several partitions, with filters and columns pushed into the queries."""
    url, more = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100, 1100).selectExpr("cast(id AS int) AS CODE", "cast(id % 7 AS int) AS BOOK", "concat('verse ', id) AS NAME").coalesce(1).write.format("jdbc").options(url=url, dbtable="verses", **more).save()
    df = jdbc_table(spark, url, "verses", "CODE", 4, **more)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and df.where("CODE IS NULL").count() == 0
    assert sorted(r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) == [250] * 4
    wanted = df.where("BOOK = 3").select("CODE")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(BOOK), *EqualTo(BOOK,3)]" in plan and "ReadSchema: struct<CODE:int>" in plan
    assert sorted(r.CODE for r in wanted.collect()) == [i for i in range(100, 1100) if i % 7 == 3]
    spark.createDataFrame([], "CODE int").coalesce(1).write.format("jdbc").options(url=url, dbtable="nothing", **more).save()
    assert jdbc_table(spark, url, "nothing", "CODE", **more).count() == 0 and jdbc_table(spark, url, "verses", **more).rdd.getNumPartitions() == 1


def test_ranges_are_read_at_their_positions(spark, tmp_path):
    """Large ranges come in chunks that differ in nothing from the file; nothing beyond the range is read."""
    content = bytes(i % 251 for i in range(10_000))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.mp3").write_bytes(content)
    (tmp_path / "f/ö two.mp3").write_bytes(b"x")
    asked = [None, "bytes=10-19", "bytes=9990-", "bytes=0-99999", "bytes=20000-", "bytes=-5", "bytes=3000-8000,1-2"]
    requests = file_stats(spark, f"file://{tmp_path}/f").select("path", "length", "modificationTime", F.explode(F.array(*[F.lit(x) for x in asked])).alias("header"))
    served = media.serve(requests, F.col("header"), F.col("length"), F.col("modificationTime"))
    rows = media.read_ranges(served, split=1000).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        assert r.body is None or len(r.body) <= 1000
        key = ("one" if "one.mp3" in r.path else "two", r.header)
        whole[key] = whole.get(key, b"") + bytes(r.body or b"")
    want = {None: content, "bytes=10-19": content[10:20], "bytes=9990-": content[9990:], "bytes=0-99999": content, "bytes=20000-": b"", "bytes=-5": content[:6], "bytes=3000-8000,1-2": content[3000:8001]}
    assert {h: whole["one", h] for h in asked} == want and whole["two", None] == b"x" and whole["two", "bytes=10-19"] == b""
    assert len([r for r in rows if "one.mp3" in r.path and r.header is None]) == 10
    assert all((r.etag is None) == (r.status == 416) for r in rows) and len({r.etag for r in rows if r.etag}) == 2
