from __future__ import annotations

import os
import re
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from codexa.operators import content, media, sync, telemetry
from codexa.operators.cache import TimedCache
from codexa.plans.queries import queries
from codexa.sources import media as media_source
from codexa.sources.payload import Settings, env_int, env_required, jdbc_table
from codexa.sources.tables import CONTENT, DDL, schema

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    """Two editions, three books, a few verses."""
    make = lambda name, rows: spark.createDataFrame([r + (None,) * (len(schema(name)) - len(r)) for r in rows], schema(name))
    verse = lambda code, tr, b, c, v: (code, tr, b, c, v, v, f"t{code}", f"h{code}", v == 1)
    return SimpleNamespace(
        languages=make("languages", [("en", "English", "English")]),
        bible_books=make("bible_books", [(1, "gen", "ge", None), (2, "exo"), (4, "num")]),
        translations=make("translations", [(1, "one", "One", None, "en", 1), (2, "two", "Two", None, "en", 1), (3, "off", "Off", None, "en", 0)]),
        voices=make("voices", [(10, "va", "A", None, 1, 0, 1, "x"), (11, "vb", "B", None, 2, 0, 0), (12, "vc", "C", None, 1, 0, None), (0, "v0", "Z", None, 1, 0, 1)]),
        translation_books=make("translation_books", [(101, 1, 1, "Genesis"), (102, 1, 2, "Exodus"), (103, 1, 3, "Odd"), (201, 2, 1, "Genesis")]),
        translation_verses=make("translation_verses", [verse(1, 1, 1, 1, 1), verse(2, 1, 1, 1, 2), verse(3, 1, 1, 2, 1), verse(4, 2, 1, 4, 1), verse(5, 1, 2, 1, 1), verse(6, 2, 9, 1, 1)]),
        voice_alignments=make("voice_alignments", [(10, 1, 1, 1, 0.0, 1.5), (10, 1, 1, 1, 2.0, 3.0), (10, 1, 1, 2, None, 4.0), (11, 1, 4, 1, 0.0, 1.0)]),
        translation_titles=make("translation_titles", [(50, "T", 1, None, None, True), (51, "Loose", None)]),
        translation_notes=make("translation_notes", [(70, 1, "n", 1, None), (71, 2, "n", None, 50), (72, 3, "n", None, None), (73, 4, "n", 1, 50)]),
        audio_files=make("audio_files", [("one", "va", 1, 1)]),
    )


def test_voices_decide_which_translations_are_listed(small):
    nested = {r.code: r for r in content.nest_voices(content.translations_with_voices(small.translations, small.voices)).collect()}
    assert set(nested) == {1}  # all voices of the second are inactive
    assert [v["code"] for v in nested[1].voices] == [10, 12]  # a null flag counts as active, code 0 as none
    alone = small.voices.where("translation = 1")
    assert {r.code: len(r.voices) for r in content.nest_voices(content.translations_with_voices(small.translations, alone)).collect()} == {1: 2, 2: 0}
    assert content.translations_with_voices(small.translations, small.voices, "de").count() == 0


def test_overview(small):
    rows = {(r.translation, r.book_number): r for r in content.books_overview(small.translation_books, small.bible_books, small.translation_verses, small.translations).collect()}
    assert rows[1, 1].chapters_count == 4 and rows[1, 1].chapters_without_text == [3, 4]  # counted over all editions
    assert rows[2, 1].chapters_without_text == [1, 2, 3]
    assert rows[1, 3].chapters_count is None and rows[1, 3].alias is None and rows[1, 3].chapters_without_text == []
    for (tr, book), r in rows.items():
        have = {x.chapter_number for x in small.translation_verses.where(f"translation = {tr} AND book_number = {book}").collect()}
        assert not have & set(r.chapters_without_text) and have | set(r.chapters_without_text) == set(range(1, (r.chapters_count or 0) + 1))


def test_missing_audio(spark, small):
    asked = spark.createDataFrame([(1, 10), (1, 11), (1, 0), (3, 10)], "translation int, voice bigint")
    got = {(r.voice, r.book_number): r.chapters_without_audio for r in content.chapters_without_audio(asked, small.translation_books, small.translation_verses, small.translations, small.voices, small.audio_files).collect()}
    assert got == {(10, 1): [2], (10, 2): [1], (10, 3): [], (11, 1): [1, 2], (11, 2): [1], (11, 3): []}


def test_navigation(small):
    info = content.books_info(small.translation_books, small.bible_books, small.translation_verses)
    have = content.chapters_by_book(small.translation_verses, small.translation_books)
    extra = have.union(have.sparkSession.createDataFrame([(1, 3, 1)], "translation int, book_number int, chapter_number int"))
    before = {(r.translation, r.book_number, r.chapter_number): (r.prev_excerpt, r.error) for r in content.prev_excerpt(extra, info, small.bible_books).collect()}
    assert before[1, 1, 1] == ("", None) and before[1, 1, 2] == ("gen 1", None) and before[1, 2, 1] == ("gen 4", None)
    after = {(r.translation, r.book_number, r.chapter_number): (r.next_excerpt, r.error) for r in content.next_excerpt(extra, info, small.bible_books).collect()}
    assert after[1, 1, 2] == ("gen 3", None) and after[2, 1, 4] == ("exo 1", None)  # listed or not
    assert after[1, 2, 1] == (None, "Book '3' not found.")  # the canon has a gap


def test_excerpts(spark, small):
    asked = spark.createDataFrame([(1, 1, 10, "gen 1"), (2, 1, None, "gen 1:2"), (3, 1, None, "gen 1:5-3"), (4, 1, None, ""), (5, 1, None, "zz 1, gen 1"), (6, 9, None, "gen 1"), (7, 1, 11, "gen 1"), (8, 1, 0, "gen 1:1-1 gen 2"), (9, 1, None, "ge 1:2-0")], "request_id bigint, translation int, voice bigint, excerpt string")
    requests, parts = content.excerpts(asked, small, "B")
    r = {x.request_id: x for x in requests.collect()}
    assert (r[1].title, r[1].is_single_chapter, r[1].error) == ("Genesis 1", True, None)
    assert (r[2].title, r[2].is_single_chapter) == ("Genesis 1", False)
    assert r[3].error == "No verses found for gen 1:5-3." and r[4].error == "Invalid excerpt format ()." and r[5].error == "Book with alias 'zz' not found for translation 1."
    assert r[6].error == "Translation 9 not found." and r[7].error == "Voice 11 not found for translation 1."
    assert (r[8].title, r[8].is_single_chapter) == ("Excerpt gen 1:1-1 gen 2", False)
    p = {(x.request_id, x.part_index): x for x in parts.collect()}
    assert {k[0] for k in p} == {1, 2, 8, 9}
    one = p[1, 0]
    assert [(v.code, v.begin, v.end) for v in one.verses] == [(1, 0.0, 1.5), (1, 2.0, 3.0), (2, 0.0, 0.0)]  # doubled alignment, missing bound
    assert one.audio_link == "B/audio/one/va/01/01.mp3" and [t.code for t in one.titles] == [50] and [n.code for n in one.notes] == [70, 71, 73]
    assert p[2, 0].audio_link == "" and [v.code for v in p[9, 0].verses] == [2]


def test_notes_come_once(small):
    verses = small.translation_verses.where("translation = 1")
    titles = content.titles_of(verses, small.translation_titles)
    assert sorted(r.code for r in content.notes_of(verses, titles, small.translation_notes).collect()) == [70, 71, 73]


LOG = DDL["api_requests"]


def log(spark, rows):
    return spark.createDataFrame([(e, "GET", s, ms, ip, "", t) for e, s, ms, ip, t in rows], LOG)


def test_rollup(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rows = log(spark, [("/a", 200, 1, "x", day(1)), ("/a", 500, 4, "x", day(1, 5)), ("/b", None, 2, "x", day(1)), (None, None, 3, None, day(2)), ("/a", 200, 1, "y", day(9))])
    got = {(r.date, r.endpoint): tuple(r)[2:] for r in telemetry.daily_stats(rows).collect()}
    assert got[date(2024, 1, 1), "/a"] == (2, 1, 3.0, 1)  # 2.5 rounds up
    assert got[date(2024, 1, 1), "/b"] == (1, 1, 2.0, None)  # no status at all
    assert got[date(2024, 1, 1), "_total_"] == (3, 1, 2.0, 1)
    assert got[date(2024, 1, 2), None] == (1, 0, 3.0, None) and got[date(2024, 1, 2), "_total_"] == (1, 0, 3.0, None)
    empty = telemetry.daily_stats(rows).limit(0)
    as_of = F.lit("2024-01-09").cast("date")
    once = telemetry.backfill(rows, empty, as_of)
    assert {r.date for r in once.collect()} == {date(2024, 1, 1), date(2024, 1, 2)}
    assert sorted(map(str, telemetry.backfill(rows, once, as_of).collect())) == sorted(map(str, once.collect()))
    trap = spark.createDataFrame([(None, "_total_", 1, 1, 1.0, 0)], telemetry.daily_stats(rows).schema)
    assert telemetry.missing_days(rows, trap, as_of).count() == 0


def test_upsert_and_retention(spark):
    a = spark.createDataFrame([(1, None, "old"), (2, "x", "old")], "k int, e string, v string")
    b = spark.createDataFrame([(1, None, "new"), (3, "y", "new")], "k int, e string, v string")
    once = telemetry.upsert(a, b, ["k", "e"])
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "new"), (2, "old"), (3, "new")]
    assert sorted(map(str, telemetry.upsert(once, b, ["k", "e"]).collect())) == sorted(map(str, once.collect()))
    rows = log(spark, [("/a", 200, 1, "x", datetime(2024, 1, 10)), ("/b", 200, 1, "x", datetime(2024, 1, 9, 23, 59)), ("/c", 200, 1, "x", None)])
    assert sorted(r.endpoint for r in telemetry.retained(rows, F.lit("2024-01-24").cast("timestamp_ntz")).collect()) == ["/a", "/c"]


def content_of(small):
    return {t: getattr(small, t) for t in CONTENT}


def test_cascade(small):
    left = sync.survivors(content_of(small), 1)
    codes = lambda t, c="code": sorted(r[0] for r in left[t].select(c).collect())
    assert codes("translation_titles") == [51] and codes("translation_notes") == [72] and codes("voice_alignments", "voice") == [11]
    assert codes("translation_verses") == [4, 6] and codes("translations") == [2, 3] and codes("voices") == [11]


def test_imports(spark, small, tmp_path):
    current = content_of(small)
    payload = {"translations": current["translations"].where("code < 3"), "languages": spark.createDataFrame([("en", "E", "E"), ("de", "D", "D")], schema("languages"))}
    new = sync.partial_import(payload, current)
    assert sorted(r.code for r in new["translations"].collect()) == [1, 2, 2, 3]  # only the first one's scope is cleared
    assert {r.alias: r.name_en for r in new["languages"].collect()} == {"en": "E", "de": "D"}
    assert sorted(r.code for r in new["translation_verses"].where("translation = 2").collect()) == [4, 6]
    with pytest.raises(ValueError, match="no translation"):
        sync.partial_import({"translations": current["translations"].limit(0)}, current)
    folder = f"file://{tmp_path}/db"
    sync.publish(sync.full_import(current, current), folder)
    first = sync.published(spark, folder)
    sync.publish(sync.partial_import(payload, first), folder)  # reads the snapshot that it replaces
    assert sync.published(spark, folder)["translations"].count() == 4
    report = {r["table"]: r["rows"] for r in sync.import_report(payload, spark).collect()}
    assert report["translations"] == 2 and report["voices"] == 0
    twice = spark.createDataFrame([("en", "1", "", 1), ("en", "2", "", 2)], "alias string, name_en string, name_national string, n int")
    assert [r.name_en for r in sync.replace_by_key(current["languages"], twice, "alias", "n").collect()] == ["2"]
    assert sync.orphans(current["translation_notes"], current["translation_titles"], "translation_title").count() == 0


def test_timed_cache(spark):
    now, made = [0.0], []
    cache = TimedCache(10, lambda: now[0])

    def make():
        made.append(1)
        return spark.range(3)

    first = cache.get("f", make, a=1, b=2)
    assert cache.get("f", make, b=2, a=1) is first and first.is_cached and first.count() == 3
    cache.get("f", make, a=2, b=2)
    now[0] = 10.0
    assert cache.get("f", make, a=1, b=2) is not first and len(made) == 3 and cache.clear() == 2 and cache.clear() == 0


def test_cache_with_a_capacity(spark):
    cache, made = TimedCache(capacity=2), []
    ask = lambda k: cache.get("f", lambda: made.append(k) or spark.range(k), k=k)
    first = ask(1)
    ask(2)
    assert ask(1) is first
    ask(3)
    ask(2)
    assert made == [1, 2, 3, 2] and not first.is_cached and cache.clear() == 2


def test_a_failed_import_leaves_the_current_snapshot(spark, small, tmp_path):
    folder, current = f"file://{tmp_path}", content_of(small)
    sync.publish(current, folder)
    broken = current | {"voices": current["voices"].withColumn("alias", F.raise_error(F.lit("broken")))}
    with pytest.raises(Exception, match="broken"):
        sync.publish(broken, folder)
    assert sync.published(spark, folder)["voices"].count() == current["voices"].count()
    sync.publish(current | {"voices": current["voices"].limit(0)}, folder)
    assert sync.published(spark, folder)["voices"].count() == 0


def test_settings(monkeypatch):
    monkeypatch.setenv("CODEXA_DB_PORT", "x")
    assert Settings.from_env().port == 3306 and env_int("CODEXA_DB_PORT", 5) == 5
    with pytest.raises(RuntimeError):
        env_required("CODEXA_NOTHING")


def test_audio_files(spark, tmp_path):
    for name in ("one/va/mp3/01/01.mp3", "one/va/mp3/01/1.mp3", "one/va/mp3/01/x.mp3", "one/va/mp3/x/1.mp3", "one/va/mp3/2/3.MP3", "one/va/mp3/2/4.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes(range(100)))
    got = media_source.audio_listing(spark, str(tmp_path))
    assert sorted((r.book, r.chapter) for r in got.collect()) == [(1, 1), (2, 4)]
    assert media_source.audio_listing(spark, str(tmp_path / "none")).count() == 0
    files = media_source.file_stats(spark, str(tmp_path / "one/va/mp3/2/4.mp3"))
    asked = files.crossJoin(spark.createDataFrame([("bytes=5-9",), (None,), ("bytes=9-5",)], "header string"))
    got = {r.status: r for r in media.read_ranges(media.serve(asked, F.col("header"), F.col("length"))).collect()}
    assert bytes(got[206].body) == bytes(range(5, 10)) and got[206].content_range == "bytes 5-9/100"
    assert len(got[200].body) == 100 and got[416].body is None and got[416].content_range == "bytes */100"


def test_plans_have_no_nested_loop(small):
    verses = small.translation_verses.where("translation = 1")
    plan = content.notes_of(verses, content.titles_of(verses, small.translation_titles), small.translation_notes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_templates_are_filled_once_for_a_book_and_chapter(spark, small):
    templates = spark.range(2000).select("id", F.element_at(F.array(F.lit("{book:02d}/{chapter}"), F.lit("{"), F.lit(""), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("link_template"))
    asked = templates.withColumn("book", F.when(F.col("id") < 1000, 1).when(F.col("id") < 1900, 3)).withColumn("chapter", F.lit(7))
    out = media.audio_urls(asked, small.bible_books)
    got = out.collect()
    assert out.columns == ["id", "link_template", "book", "chapter", "url"] and len(got) == 2000
    assert all(r.url == ("01/7" if r.id % 4 == 0 and r.id < 1000 else "") for r in got)  # no such book, no book, an error, no template
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filling = plan[: plan.index("regexp_extract_all")].splitlines()[-1]
    assert "Aggregate [link_template" in plan[plan.index("regexp_extract_all") :], filling  # below the filling: distinct keys


def test_gaps_across_blocks_of_chapters(spark, small, monkeypatch):
    monkeypatch.setattr(content, "BLOCK", 2)
    verses = small.translation_verses.unionByName(spark.createDataFrame([(7, 1, 1, 7, 1, 1, "t", "h", True)], schema("translation_verses")))
    got = {(r.translation, r.book_number): r.chapters_without_text for r in content.books_overview(small.translation_books, small.bible_books, verses, small.translations).collect()}
    assert got[1, 1] == [3, 4, 5, 6] and got[2, 1] == [1, 2, 3, 5, 6, 7] and got[1, 2] == [] and got[1, 3] == []


def test_voices_that_share_a_folder(spark, small):
    voices = small.voices.withColumn("alias", F.when(F.col("code") != 11, "va").otherwise(F.col("alias")))
    asked = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 12)], "translation int, voice bigint")
    out = content.chapters_without_audio(asked, small.translation_books, small.translation_verses, small.translations, voices, small.audio_files)
    assert {(r.translation, r.voice, r.book_number): r.chapters_without_audio for r in out.collect()} == {
        (1, 10, 1): [2], (1, 10, 2): [1], (1, 10, 3): [], (1, 12, 1): [2], (1, 12, 2): [1], (1, 12, 3): [], (1, 11, 1): [1, 2], (1, 11, 2): [1], (1, 11, 3): [], (2, 12, 1): [4],
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "Aggregate [translation#" in plan and not [x for x in plan.splitlines() if "Aggregate" in x and "voice#" in x]  # gaps are of folders, not of voices


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("query", ["chapter_verses", "chapters_without_audio"])
def test_voices_are_not_paired_with_verses_before_shuffles(spark, query):
    plan = queries()[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\(code#\d+L \+ code#\d+L\)", plan)) == 1 and "* 5) + (" in plan  # verses are paired once, and with classes


def test_errors_of_excerpts_need_no_texts(spark, small):
    asked = spark.createDataFrame([(1, 1, 10, "gen 1:1-9")], "request_id bigint, translation int, voice bigint, excerpt string")
    plan = content.excerpts(asked, small)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # neither verses nor headings nor notes


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_only_voices_that_are_asked_for_are_paired_with_verses(spark):
    plan = queries()["excerpt_parts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs = re.findall(r"\(code#\d+L \+ (code#\d+L)\)", plan)
    assert pairs and all(re.search(rf"Join LeftSemi, \(+({re.escape(code)} = voice#\d+L|voice#\d+L = {re.escape(code)}|alias#\d+ = voice_alias#\d+)", plan) for code in pairs)


def test_gaps_are_found_by_blocks_and_shown_before_voices_repeat_them(spark, small, monkeypatch):
    monkeypatch.setattr(content, "BLOCK", 1)
    asked = spark.createDataFrame([(1, 11), (1, 12)], "translation int, voice bigint")
    voices = spark.createDataFrame([(11, "va"), (12, "vb")], "code bigint, alias string")
    have = small.translation_books, small.translation_verses, small.translations, voices
    plain = content.chapters_without_audio(asked, *have, small.audio_files)
    shown = content.chapters_without_audio(asked, *have, small.audio_files, shown=lambda c: F.array_join(c.cast("array<string>"), "+"))
    assert {(r.voice, r.book_number): r.chapters_without_audio for r in shown.collect()} == {(r.voice, r.book_number): "+".join(map(str, r.chapters_without_audio)) for r in plain.collect()}
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan.split("Join")[0].replace("array_join(cast([]", "")
