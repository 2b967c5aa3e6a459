"""The import of texts as editions: what is imported, and what a second run over changed input does."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codexa.operators import sync
from codexa.sources import partitions
from jobs import import_texts
from jobs.common import command_line

DOCS = "doc_id bigint, text string, lang string, source string"
ROWS = [
    (1, "One.\n\n  Two & <three> \t\nFour", "en", "a"), (2, " \n\t\n", "en", "a"), (3, None, "en", "a"), (4, "Ein", "de", "a"), (None, "no id", "de", "a"), (4, "Ein", "de", "a"),
    (5, "", None, None), (6, "it's", "x/y", "o'b\\c"), (7, "deux\r\ntrois\n", "fr", "b"),
]


@pytest.fixture
def job(spark, tmp_path):
    base = f"file://{tmp_path}"

    def run(rows, **settings):
        spark.createDataFrame(rows, DOCS).repartition(2).write.mode("overwrite").parquet(f"{base}/docs")
        return import_texts.run(spark, f"{base}/docs", f"{base}/out", **settings)

    run.out, run.shown = f"{base}/out", lambda: sorted(map(str, import_texts.result(spark, f"{base}/out").collect()))
    return run


def test_verses(spark, job):
    done = job(ROWS)
    assert done == {"documents": 9, "imported": ["de-a", "en-a", "fr-b", "und-none", "x/y-o'b\\c"], "verses": 9, "dropped": []}
    got = import_texts.result(spark, job.out)
    one = got.where("doc_id = 1").orderBy("verse_number").select("verse_number", "text", "html", "start_paragraph").collect()
    assert [tuple(r) for r in one] == [(1, "One.", "<p>One.</p>", True), (2, "Two & <three>", "<p>Two &amp; &lt;three&gt;</p>", True), (3, "Four", "<p>Four</p>", False)]
    assert got.where("doc_id in (2, 3, 5) AND verse_number IS NULL AND text IS NULL").count() == 3
    totals = {r.edition: (r.language, r.documents, r.documents_without_text, r.verses) for r in got.collect()}
    assert totals == {"en-a": ("en", 3, 2, 3), "de-a": ("de", 3, 0, 3), "und-none": ("und", 1, 1, 0), "x/y-o'b\\c": ("x/y", 1, 0, 1), "fr-b": ("fr", 1, 0, 2)}


def test_only_changed_editions_are_imported(spark, job, tmp_path):
    job(ROWS)
    before, files = job.shown(), {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/verses/**/*.parquet")}
    assert job(ROWS[::-1]) == {"documents": 9, "imported": [], "verses": 0, "dropped": []} and job.shown() == before
    changed = [*ROWS[:3], (8, "new", "en", "a"), *ROWS[3:5], ROWS[6], (9, "neu", "nl", "c")]  # a copy, an edition with odd letters and one more gone
    done = job(changed)
    assert done["imported"] == ["de-a", "en-a", "nl-c"] and done["dropped"] == ["fr-b", "x/y-o'b\\c"]
    after = job.shown()
    left = {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/verses/**/*.parquet")}
    assert {p for p in left if files.get(p) == left[p]} == {p for p in files if "und-none" in str(p)}
    job.out = job.out + "2"
    import_texts.run(spark, f"file://{tmp_path}/docs", job.out)
    assert sorted(map(str, import_texts.result(spark, job.out).collect())) == after


def test_a_run_that_ended_half_way_is_made_good(spark, job, monkeypatch):
    job(ROWS)
    changed, replace = [*ROWS, (10, "more", "fr", "b")], partitions.replace

    def broken(df, folder, *by):
        if folder.endswith("editions"):
            raise OSError("lost")
        replace(df, folder, *by)

    monkeypatch.setattr(partitions, "replace", broken)
    with pytest.raises(OSError, match="lost"):
        job(changed)
    monkeypatch.setattr(partitions, "replace", replace)
    assert job(changed)["imported"] == ["fr-b"] and any("more" in x for x in job.shown())
    assert job(changed)["imported"] == []


def test_an_edition_whose_texts_become_empty(job):
    job([(1, "a\nb", "en", "a"), (2, "c", "en", "b")])
    assert job([(1, "", "en", "a"), (2, "c", "en", "b")])["imported"] == ["en-a"]
    assert len(job.shown()) == 2 and not any("text='a'" in x for x in job.shown())


def test_no_rows(spark, job):
    assert job([])["imported"] == [] and job.shown() == []
    job(ROWS)
    assert len(job([])["dropped"]) == 5 and job.shown() == []


def test_command_line(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/docs")
    (tmp_path / "config.json").write_text(json.dumps({"language": "zz", "source": "web"}))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    argv = ["--documents", f"{tmp_path}/docs", "--out", f"{tmp_path}/out", "--config", f"{tmp_path}/config.json"]
    assert "zz-web" in command_line("import_texts", "import_texts.json", {"documents": "", "out": ""}, import_texts.run, argv)["imported"]


def test_digests(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", None, "y"), ("b", 1, "x"), ("c", None, "x"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, n int, `t.x` string")
    of = lambda d: {r.g: (r.rows, r.digest) for r in sync.digests(d, "g").collect()}
    assert of(df) == of(df.orderBy(F.desc("n"))) and len({v for v in of(df).values()}) == 4
    now, before = sync.digests(df, "g"), sync.digests(df.where("g <> 'c'").union(spark.createDataFrame([("b", 1, "x"), ("e", 1, "x")], df.schema)), "g")
    assert {r.g: r.state for r in sync.compared(now, before, "g").collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "same", "e": "gone"}
