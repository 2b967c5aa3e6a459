"""Content queries over editions, their sections, verses, headings, notes and narrations; all work on sets of requests.

A request that the service would refuse comes back with its reason in `error` instead of failing the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.functions import scalars as S

LAST_BOOK = 66
#: Chapters of a book that are looked at together for gaps.
BLOCK = 4096
ALIASES = ("code1", "code2", "code3", "code4", "code5", "short_name_en", "short_name_ru")


def translations_with_voices(translations: DataFrame, voices: DataFrame, language: str | None = None) -> DataFrame:
    """Active translations with their active voices, one row a pair; one without voices stays, one with only inactive voices goes."""
    v = voices.select("translation", *[F.col(c).alias(f"voice_{c}") for c in ("code", "alias", "name", "description", "is_music", "active")])
    out = translations.join(v, translations.code == v.translation, "left").drop("translation").where((F.col("active") == 1) & ((F.col("voice_active") == 1) | F.col("voice_active").isNull()))
    return out.where(F.col("language") == language) if language else out


def nest_voices(pairs: DataFrame) -> DataFrame:
    """One row a translation with its voices as an array of structs by code; a voice of code 0 counts as none."""
    own = ["code", "alias", "name", "description", "language", "active"]
    voice = F.when(F.col("voice_code").isNotNull() & (F.col("voice_code") != 0), F.struct(F.col("voice_code").alias("code"), F.col("voice_alias").alias("alias"), F.col("voice_name").alias("name"), F.col("voice_description").alias("description"), F.col("voice_is_music").cast("boolean").alias("is_music"), F.col("voice_active").cast("boolean").alias("active")))
    return pairs.groupBy(*own).agg(F.sort_array(F.collect_list(voice)).alias("voices")).withColumn("active", F.col("active").cast("boolean"))


def chapters_by_book(verses: DataFrame, books: DataFrame) -> DataFrame:
    """Distinct chapters of each translation's listed books."""
    return verses.join(books.select("translation", "book_number"), ["translation", "book_number"], "left_semi").select("translation", "book_number", "chapter_number").distinct()


def chapter_counts(verses: DataFrame) -> DataFrame:
    """The last chapter of each book over all translations."""
    return verses.groupBy("book_number").agg(F.max("chapter_number").alias("chapters_count"))


def books_info(books: DataFrame, canon: DataFrame, verses: DataFrame) -> DataFrame:
    """Listed books with their canon entry and chapter count; either is null where there is none."""
    c = canon.select(F.col("number").alias("book_number"), F.col("code1").alias("alias"), *[f"code{i}" for i in range(2, 10)], "short_name_en", "short_name_ru")
    return books.join(c, "book_number", "left").join(chapter_counts(verses), "book_number", "left")


def match_alias(alias: Column, collation: str | None = None) -> Column:
    """Whether an alias names a row of books_info, under a collation if one is given; codes 6 to 9 are not looked at."""
    asked = F.collate(alias, collation) if collation else alias
    out = F.lit(False)
    for c in ("alias", *ALIASES[1:]):
        out = out | F.coalesce(F.col(c) == asked, F.lit(False))
    return out


def books_by_alias(aliases: DataFrame, info: DataFrame, collation: str | None = None) -> DataFrame:
    """aliases (translation, asked) with code, book_number and alias of the books of books_info that they name, null where none does.

    A book with an alias in several columns is found once, two books with equal aliases both. collation: how aliases compare,
    as UTF8_LCASE does without regard to case; by their bytes otherwise. One join by equality on the listed aliases.
    """
    key = lambda x: F.collate(x, collation) if collation else x
    listed = info.select("translation", "code", "book_number", "alias", F.explode(F.array_distinct(F.array_compact(F.array("alias", *ALIASES[1:])))).alias("_name"))
    listed = listed.select("translation", "code", "book_number", "alias", key(F.col("_name")).alias("_key")).dropDuplicates(["translation", "code", "book_number", "_key"])
    return aliases.withColumn("_key", key(F.col("asked"))).join(listed, ["translation", "_key"], "left").drop("_key")


def books_overview(books: DataFrame, canon: DataFrame, verses: DataFrame, translations: DataFrame) -> DataFrame:
    """Listed books of active translations with the chapters that lack text (of 1 to the last over all translations)."""
    info = books_info(books, canon, verses).join(translations.where("active = 1").select(F.col("code").alias("translation")), "translation", "left_semi")
    key = ["translation", "book_number"]
    block = lambda n: F.floor((n - 1) / BLOCK).cast("int")
    have = chapters_by_book(verses, books).groupBy(*key, block(F.col("chapter_number")).alias("block")).agg(F.collect_set("chapter_number").alias("have"))  # BLOCK chapters at most
    cells = info.where("chapters_count > 0").select(*key, "chapters_count").distinct()
    cells = cells.select(*key, "chapters_count", F.explode(F.sequence(F.lit(0), block(F.col("chapters_count")))).alias("block"))
    all_of = F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("chapters_count"), (F.col("block") + 1) * BLOCK))
    gaps = cells.join(have, [*key, "block"], "left").select(*key, F.struct("block", F.array_except(all_of, F.coalesce("have", F.array().cast("array<int>"))).alias("gaps")).alias("x"))
    missing = gaps.groupBy(*key).agg(F.flatten(F.array_sort(F.collect_list("x"))["gaps"]).alias("chapters_without_text"))
    out = info.join(missing, ["translation", "book_number"], "left")
    return out.select("translation", "code", "book_number", "name", "alias", "chapters_count", F.coalesce("chapters_without_text", F.array().cast("array<int>")).alias("chapters_without_text"))


def chapters_without_audio(requests: DataFrame, books: DataFrame, verses: DataFrame, translations: DataFrame, voices: DataFrame, files: DataFrame, shown: Callable[[Column], Column] = lambda chapters: chapters) -> DataFrame:
    """For each request (translation, voice) and listed book, chapters with text but no audio file, ascending.

    Any existing voice is taken, also an inactive one or another translation's; a voice of code 0 or null counts as none. Files
    are looked for once in each folder (translation and voice by their aliases), however many voices have the same one. shown:
    what to make of the chapters, also once a folder.
    """
    t = translations.where("active = 1").select(F.col("code").alias("translation"), F.col("alias").alias("translation_alias"))
    v = voices.select(F.col("code").alias("voice"), F.col("alias").alias("voice_alias"))
    asked = requests.where("voice <> 0").join(t, "translation").join(v, "voice")
    have = chapters_by_book(verses, books).withColumnsRenamed({"book_number": "book", "chapter_number": "chapter"})
    folders = asked.select("translation", "translation_alias", "voice_alias").distinct()
    gaps = folders.join(have, "translation").join(files, ["translation_alias", "voice_alias", "book", "chapter"], "left_anti")
    key = ["translation", "voice_alias", "book"]
    gaps = gaps.groupBy(*key, F.floor((F.col("chapter") - 1) / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_set("chapter")).alias("gaps"))  # BLOCK chapters at most
    gaps = gaps.groupBy(*key).agg(shown(F.flatten(F.array_sort(F.collect_list(F.struct("block", "gaps")))["gaps"])).alias("chapters_without_audio"))
    listed = asked.select("translation", "voice", "voice_alias").join(books.select("translation", F.col("book_number").alias("book")), "translation")
    return listed.join(gaps, key, "left").select("translation", "voice", F.col("book").alias("book_number"), F.coalesce("chapters_without_audio", shown(F.array().cast("array<int>"))).alias("chapters_without_audio"))


def _missing(number: Column) -> Column:
    return F.concat(F.lit("Book '"), number.cast("string"), F.lit("' not found."))


def with_prev(rows: DataFrame, info: DataFrame, canon: DataFrame) -> DataFrame:
    """rows (translation, book_number, alias, chapter_number) with prev_excerpt and prev_error."""
    before = canon.select((F.col("number") + 1).alias("book_number"), F.col("code1").alias("_alias"), F.lit(True).alias("_in_canon"))
    listed = info.select("translation", (F.col("book_number") + 1).alias("book_number"), F.col("chapters_count").cast("string").alias("_count"), F.lit(True).alias("_listed"))
    out = rows.join(F.broadcast(before), "book_number", "left").join(listed, ["translation", "book_number"], "left")
    inside, first, unknown = F.col("chapter_number") > 1, F.col("book_number") == 1, F.col("_in_canon").isNull()
    text = F.when(inside, F.concat("alias", F.lit(" "), (F.col("chapter_number") - 1).cast("string"))).when(first, "").when(unknown, None).when(F.col("_listed"), F.concat("_alias", F.lit(" "), F.coalesce("_count", F.lit("None")))).otherwise("")
    error = F.when(~inside & ~first & unknown, _missing(F.col("book_number") - 1))
    return out.withColumns({"prev_excerpt": text, "prev_error": error}).drop("_alias", "_in_canon", "_count", "_listed")


def with_next(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """rows (book_number, alias, chapters_count, chapter_number) with next_excerpt and next_error."""
    after = canon.select((F.col("number") - 1).alias("book_number"), F.col("code1").alias("_alias"), F.lit(True).alias("_in_canon"))
    out = rows.join(F.broadcast(after), "book_number", "left")
    inside, last, unknown = F.coalesce(F.col("chapter_number") < F.col("chapters_count"), F.lit(False)), F.col("book_number") == LAST_BOOK, F.col("_in_canon").isNull()
    text = F.when(inside, F.concat("alias", F.lit(" "), (F.col("chapter_number") + 1).cast("string"))).when(last, "").when(F.coalesce("_alias", F.lit("")) == "", F.when(~unknown, "")).otherwise(F.concat("_alias", F.lit(" 1")))
    error = F.when(~inside & ~last & unknown, _missing(F.col("book_number") + 1))
    return out.withColumns({"next_excerpt": text, "next_error": error}).drop("_alias", "_in_canon")


def prev_excerpt(chapters: DataFrame, info: DataFrame, canon: DataFrame) -> DataFrame:
    """chapters (translation, book_number, chapter_number) with prev_excerpt, '' at the start, and error where the canon lacks the neighbour.

    At a first chapter: the previous book's last chapter over all translations, '' where the translation doesn't list it.
    """
    own = chapters.join(info.select("translation", "book_number", "alias"), ["translation", "book_number"])
    return with_prev(own, info, canon).select("translation", "book_number", "chapter_number", "prev_excerpt", F.col("prev_error").alias("error"))


def next_excerpt(chapters: DataFrame, info: DataFrame, canon: DataFrame) -> DataFrame:
    """The same for next_excerpt: chapter 1 of the next book in the canon, whether the translation lists it or not."""
    own = chapters.join(info.select("translation", "book_number", "alias", "chapters_count"), ["translation", "book_number"])
    return with_next(own, canon).select("translation", "book_number", "chapter_number", "next_excerpt", F.col("next_error").alias("error"))


def translation_lookup(requests: DataFrame, translations: DataFrame) -> DataFrame:
    """requests (translation) with the name of the active translation, or error."""
    t = translations.where("active = 1").groupBy(F.col("code").alias("translation")).agg(F.min("name").alias("name"))
    return requests.join(t, "translation", "left").withColumn("error", F.when(F.col("name").isNull(), F.concat(F.lit("Translation "), F.col("translation").cast("string"), F.lit(" not found."))))


def voice_info(requests: DataFrame, voices: DataFrame, translations: DataFrame) -> DataFrame:
    """requests (voice, translation) with aliases and template of the voice, or error unless both are active and belong together."""
    v = voices.where("active = 1").select(F.col("code").alias("voice"), "translation", F.col("alias").alias("voice_alias"), "link_template")
    t = translations.where("active = 1").select(F.col("code").alias("translation"), F.col("alias").alias("translation_alias"))
    out = requests.join(v.join(t, "translation"), ["voice", "translation"], "left")
    return out.withColumn("error", F.when(F.col("voice_alias").isNull(), F.concat(F.lit("Voice "), F.col("voice").cast("string"), F.lit(" not found for translation "), F.col("translation").cast("string"), F.lit("."))))


def book_numbers(aliases: DataFrame, canon: DataFrame, collation: str | None = None) -> DataFrame:
    """aliases (alias) with the canon's number, as text, or error; aliases compare under a collation if one is given."""
    key = lambda x: F.collate(x, collation) if collation else x
    c = canon.select(key(F.col("code1")).alias("_key"), F.col("number").cast("string").alias("number"))
    found = aliases.withColumn("_key", key(F.col("alias"))).join(F.broadcast(c), "_key", "left").drop("_key")
    return found.withColumn("error", F.when(F.col("number").isNull(), F.concat(F.lit("Book '"), F.col("alias"), F.lit("' not found."))))


def chapter_verses(requests: DataFrame, verses: DataFrame, alignments: DataFrame) -> DataFrame:
    """requests (key..., translation, book_number, chapter_number, voice, start_verse, end_verse) joined with their verses and timing.

    Without start_verse the whole chapter; a reversed range gives none; duplicate alignments give a verse more than once; a
    bound that is missing makes both 0.
    """
    v = verses.select("translation", "book_number", "chapter_number", "code", "verse_number", "verse_number_join", "html", "text", "start_paragraph")
    a = alignments.select("voice", "book_number", "chapter_number", "verse_number", "begin", "end")
    hit = requests.join(v, ["translation", "book_number", "chapter_number"]).where(F.col("start_verse").isNull() | F.col("verse_number").between(F.col("start_verse"), F.col("end_verse")))
    begin, end = S.timing(F.col("begin"), F.col("end"))
    return hit.join(a, ["voice", "book_number", "chapter_number", "verse_number"], "left").withColumns({"begin": begin, "end": end})


def titles_of(verses: DataFrame, titles: DataFrame) -> DataFrame:
    """Headings before any of the verses (code)."""
    return titles.join(verses.select(F.col("code").alias("before_translation_verse")), "before_translation_verse", "left_semi").select(titles.columns)


def notes_of(verses: DataFrame, titles: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of any of the verses or of any of the titles (code), each once: two semi-joins, as a union."""
    by_verse = notes.join(verses.select(F.col("code").alias("translation_verse")), "translation_verse", "left_semi").select(notes.columns)
    by_title = notes.join(titles.select(F.col("code").alias("translation_title")), "translation_title", "left_semi").select(notes.columns)
    other = by_title.join(verses.select(F.col("code").alias("translation_verse")), "translation_verse", "left_anti").select(notes.columns)
    return by_verse.unionByName(other)


def excerpt_parts(requests: DataFrame) -> DataFrame:
    """requests (request_id, translation, voice, excerpt) as one row a part of the reference; a request without parts has one row with part_index null."""
    parsed = requests.select("*", F.posexplode_outer(S.parse_references(F.col("excerpt"))).alias("part_index", "part"))
    start, end = S.verse_bounds(F.col("part.start_text"), F.col("part.end_text"))
    label = F.concat("part.book", F.lit(" "), F.col("part.chapter_text"), F.coalesce(F.concat(F.lit(":"), S.range_label(F.col("part.start_text"), F.col("part.end_text"))), F.lit("")))
    return parsed.select("request_id", "translation", "voice", "excerpt", "part_index", F.col("part.book").alias("book"), F.col("part.chapter").alias("chapter_number"), start.alias("start_verse"), end.alias("end_verse"), label.alias("label"))


def excerpts(requests: DataFrame, tables, base_url: str = "") -> tuple[DataFrame, DataFrame]:
    """All requested excerpts: (requests with title, is_single_chapter, error; parts with book, navigation, audio link, verses, titles, notes).

    The first part in order that has no book or no verses makes its whole request an error; such requests have no parts. Of
    alignments and files only those of voices that are asked for are looked at; errors are told from the numbers of the verses
    alone, before any text is joined.
    """
    parts = excerpt_parts(requests)
    t = tables.translations.where("active = 1").select(F.col("code").alias("translation"), F.col("alias").alias("translation_alias"))
    wanted = voice_info(requests.where("voice <> 0").select("voice", "translation").distinct(), tables.voices, tables.translations)
    wanted = wanted.select("voice", "translation", F.col("voice_alias").alias("voice_alias"), F.col("error").alias("voice_error"))
    info = books_info(tables.translation_books, tables.bible_books, tables.translation_verses)
    names = info.select("translation", F.col("code").alias("book_code"), "book_number", F.col("name").alias("book_name"), "alias", "chapters_count", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col("alias" if c == "code1" else c) for c in ALIASES])))).alias("book"))
    first = names.groupBy("translation", "book").agg(F.min_by(F.struct("book_code", "book_number", "book_name", "alias", "chapters_count"), "book_code").alias("b"))
    found = parts.join(first, ["translation", "book"], "left").select(parts["*"], "b.*")
    key = ["request_id", "part_index"]
    called = requests.where("voice IS NOT NULL").select("voice").distinct()
    alignments = tables.voice_alignments.join(called, "voice", "left_semi")
    verses = chapter_verses(found.select(*key, "translation", "voice", "book_number", "chapter_number", "start_verse", "end_verse"), tables.translation_verses, alignments)
    nested = verses.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("verse_number", "code", "verse_number_join", "html", "text", "begin", "end", "start_paragraph"))).alias("verses"))
    codes = verses.select(*key, "code").distinct()
    titles = codes.join(tables.translation_titles.withColumnRenamed("code", "title_code"), codes.code == F.col("before_translation_verse"))
    title_rows = titles.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("title_code").alias("code"), "text", F.col("before_translation_verse").alias("before_verse_code"), "metadata", "reference", "subtitle", "position_text", "position_html"))).alias("titles"))
    n = tables.translation_notes.select(F.col("code").alias("note_code"), "note_number", F.col("text").alias("note_text"), "translation_verse", "translation_title", "position_text", "position_html")
    by_verse = codes.join(n, codes.code == n.translation_verse).select(*key, *n.columns)
    by_title = titles.select(*key, "title_code").join(n, F.col("title_code") == n.translation_title).select(*key, *n.columns)
    notes = by_verse.unionByName(by_title).dropDuplicates([*key, "note_code"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("note_code").alias("code"), F.col("note_number").alias("number"), F.col("note_text").alias("text"), F.col("translation_verse").alias("verse_code"), F.col("translation_title").alias("title_code"), "position_text", "position_html"))).alias("notes"))
    aliases = tables.voices.join(called, F.col("code") == called.voice, "left_semi").select(F.col("alias").alias("voice_alias")).distinct()
    files = tables.audio_files.join(aliases, "voice_alias", "left_semi").select("translation_alias", "voice_alias", F.col("book").alias("book_number"), F.col("chapter").alias("chapter_number"), F.lit(True).alias("has_file")).distinct()
    place = ["translation", "book_number", "chapter_number"]
    numbers = tables.translation_verses.groupBy(*place).agg(F.collect_set("verse_number").alias("_numbers"))  # of one chapter
    judged = with_next(with_prev(found.join(numbers, place, "left"), info, tables.bible_books), tables.bible_books)
    judged = judged.join(t, "translation", "left").join(wanted, ["voice", "translation"], "left")
    any_verse = F.col("_numbers").isNotNull() & (F.col("start_verse").isNull() | F.coalesce(F.exists("_numbers", lambda n: n.between(F.col("start_verse"), F.col("end_verse"))), F.lit(False)))
    tr = F.col("translation").cast("string")
    error = (
        F.when(F.col("translation_alias").isNull(), F.concat(F.lit("Translation "), tr, F.lit(" not found.")))
        .when(F.col("voice_error").isNotNull(), F.col("voice_error"))
        .when(F.col("part_index").isNull(), F.concat(F.lit("Invalid excerpt format ("), F.col("excerpt"), F.lit(").")))
        .when(F.col("book_number").isNull(), F.concat(F.lit("Book with alias '"), F.col("book"), F.lit("' not found for translation "), tr, F.lit(".")))
        .when(~any_verse, F.concat(F.lit("No verses found for "), F.col("label"), F.lit(".")))
        .otherwise(F.coalesce("prev_error", "next_error"))
    )
    judged = judged.withColumn("part_error", error).drop("_numbers")
    first_error = F.min_by("part_error", F.when(F.col("part_error").isNotNull(), F.coalesce("part_index", F.lit(-1))))
    by_request = judged.groupBy("request_id", "excerpt").agg(first_error.alias("error"), F.count("part_index").alias("n_parts"), F.max(F.col("start_verse").isNotNull()).alias("ranged"), F.min_by(F.concat("book_name", F.lit(" "), F.col("chapter_number").cast("string")), "part_index").alias("one"))
    good = F.col("error").isNull()
    titled = by_request.select("request_id", "n_parts", F.when(good, F.when(F.col("n_parts") == 1, F.col("one")).otherwise(F.concat(F.lit("Excerpt "), F.col("excerpt")))).alias("title"), F.when(good, (F.col("n_parts") == 1) & ~F.col("ranged")).alias("is_single_chapter"), "error")
    good = judged.withColumn("_error", first_error.over(W.partitionBy("request_id"))).where("_error IS NULL")
    whole = good.join(nested, key, "left").join(title_rows, key, "left").join(notes, key, "left").join(files, ["translation_alias", "voice_alias", "book_number", "chapter_number"], "left")
    link = S.audio_link(base_url, F.col("translation_alias"), F.col("voice_alias"), F.col("book_number"), F.col("chapter_number"), F.col("has_file"))
    shown = whole.withColumns({"audio_link": link, "titles": F.coalesce("titles", F.array().cast(title_rows.schema["titles"].dataType)), "notes": F.coalesce("notes", F.array().cast(notes.schema["notes"].dataType))})
    book = F.struct(F.col("book_code").alias("code"), F.col("book_number").alias("number"), F.col("alias"), F.col("book_name").alias("name"), "chapters_count").alias("book")
    return titled, shown.select("request_id", "part_index", book, "prev_excerpt", "next_excerpt", "chapter_number", "audio_link", "verses", "titles", "notes")
