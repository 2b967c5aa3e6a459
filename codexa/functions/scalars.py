"""Scalar mini-languages as functions from columns to columns: references, templates, byte ranges, versions, endpoints.

All are compositions of built-in functions; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.templates import format_fields

#: The reference notation, the endpoints that are merged, what is never logged.
REFERENCE = r"([0-9a-z]+) (\d+)(:(\d+)(?:-(\d+))?)?"
ENDPOINT_RULES = ((r"^/api/audio/.+", "/api/audio/*"), (r"^/api/translations/\d+/books", "/api/translations/*/books"))
EXCLUDED_PATHS = ("/docs", "/openapi.json", "/redoc", "/favicon.ico")
EXCLUDED_STATUS = (403, 404)
LONG_BOOK = 19


def parse_references(excerpt: Column) -> Column:
    """All parts of a reference string, in order. What doesn't match is skipped; a chapter beyond all integers is null, with its text beside it."""
    found = F.regexp_extract_all(excerpt, F.lit(REFERENCE), 0)
    group = lambda x, i: F.nullif(F.regexp_extract(x, f"^{REFERENCE}$", i), F.lit(""))
    return F.transform(found, lambda x: F.struct(group(x, 1).alias("book"), group(x, 2).try_cast("int").alias("chapter"), group(x, 4).alias("start_text"), group(x, 5).alias("end_text"), F.regexp_replace(group(x, 2), "^0+(?=.)", "").alias("chapter_text")))


def verse_bounds(start_text: Column, end_text: Column) -> tuple[Column, Column]:
    """First and last verse; the end defaults to the start, an end of 0 counts as missing, and what is beyond all integers is the last of them."""
    number = lambda text: F.when(text.isNotNull(), F.coalesce(text.try_cast("int"), F.lit(2**31 - 1)))
    start = number(start_text)
    return start, F.coalesce(F.nullif(number(end_text), F.lit(0)), start)


def range_label(start_text: Column, end_text: Column) -> Column:
    """`a` or `a-b`; compares the texts, not the numbers."""
    return F.when(end_text.isNull() | (start_text == end_text), start_text).otherwise(F.concat(start_text, F.lit("-"), end_text))


def zero_fill(number: Column, width: int) -> Column:
    """Pads with zeros on the left; unlike lpad, never cuts."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def timing(begin: Column, end: Column) -> tuple[Column, Column]:
    """If either bound is missing, both are 0."""
    missing = begin.isNull() | end.isNull()
    return F.when(missing, 0.0).otherwise(begin), F.when(missing, 0.0).otherwise(end)


def audio_link(base: str, translation: Column, voice: Column, book: Column, chapter: Column, exists: Column) -> Column:
    path = F.concat(F.lit(f"{base}/audio/"), translation, F.lit("/"), voice, F.lit("/"), zero_fill(book, 2), F.lit("/"), zero_fill(chapter, 2), F.lit(".mp3"))
    return F.when(exists, path).otherwise("")


def expand_template(template: Column, number: Column, chapter: Column, code1: Column, code2: Column, code3: Column) -> Column:
    """The template with its ten fields filled, as `templates.format_fields` does; '' for an empty template, an unknown book and every error."""
    fill = {
        "book_zerofill": zero_fill(number, 2),
        "chapter_zerofill": zero_fill(chapter, 2),
        "chapter_zerofill3": zero_fill(chapter, 3),
        "chapter_zerofill_ps3": F.when(number == LONG_BOOK, zero_fill(chapter, 3)).otherwise(zero_fill(chapter, 2)),
        "book": number,
        "chapter": chapter,
        "book_alias": code1,
        "book_alias_upper": F.upper(code1),
        "book_code2": F.coalesce(code2, F.lit("")),
        "book_code3": F.coalesce(code3, F.lit("")),
    }
    known = number.isNotNull() & chapter.isNotNull() & code1.isNotNull()
    return F.coalesce(F.when(known, format_fields(template, fill, ("book", "chapter"))), F.lit(""))


def byte_range(header: Column, size: Column) -> Column:
    """(start, end), both inclusive, or null where the header isn't a range that fits: the first of a list, clamped; a missing start is 0."""
    spec = F.split_part(F.substring(header, F.lit(7), F.length(header)), F.lit(","), F.lit(1))
    parts = F.split(spec, "-", 2)
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    number = lambda x, default: F.when(x == "", default).otherwise(x.try_cast("bigint"))
    start, end = F.greatest(number(first, F.lit(0).cast("bigint")), F.lit(0)), number(second, size - 1)
    end = F.when(end.isNotNull(), F.least(end, size - 1))
    start = F.when(number(first, F.lit(0).cast("bigint")).isNotNull(), start)
    good = header.startswith("bytes=") & second.isNotNull() & (start <= end)
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))


def content_range(span: Column, size: Column) -> Column:
    return F.when(span.isNull(), F.format_string("bytes */%d", size)).otherwise(F.format_string("bytes %d-%d/%d", span.start, span.end, size))


def version(text: Column) -> Column:
    """Numbers between dots, as an array that orders as versions do; an error where one is no number."""
    return F.transform(F.split(text, "[.]"), lambda x: x.cast("decimal(38,0)"))


def update_type(app: Column, least: Column, latest: Column) -> Column:
    return F.when(version(app) < version(least), "hard").when(version(app) < version(latest), "soft").otherwise("none")


def normalize_endpoint(path: Column) -> Column:
    """The first rule that matches at the start replaces the whole path."""
    out = None
    for pattern, name in ENDPOINT_RULES:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise(path)


def logged(path: Column, status: Column) -> Column:
    return path.startswith("/api/") & ~path.isin(*EXCLUDED_PATHS) & ~status.isin(*EXCLUDED_STATUS)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer, else `unknown`; an empty header counts as absent."""
    return F.coalesce(F.trim(F.split_part(F.nullif(forwarded, F.lit("")), F.lit(","), F.lit(1))), peer, F.lit("unknown"))


def user_agent(header: Column) -> Column:
    return F.substring(F.coalesce(header, F.lit("")), 1, 512)


def elapsed_ms(seconds: Column) -> Column:
    return (seconds * 1000).cast("int")


def numbers_to(n: Column) -> Column:
    """1 to n; nothing where n is null or below 1."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def unsafe_parameter(**parameters: Column) -> Column:
    """The name of the first parameter that could leave its folder, or null."""
    out = F.lit(None).cast("string")
    for name, value in reversed(parameters.items()):
        out = F.when(value.contains("..") | value.contains("/") | value.contains("\\"), name).otherwise(out)
    return out


def cache_key(name: str, *arguments: Column) -> Column:
    """A name and the hash of its arguments as canonical JSON."""
    return F.concat(F.lit(f"{name}:"), F.md5(F.to_json(F.struct(*arguments)).cast("binary")))


def etag(modified: Column, length: Column) -> Column:
    """A reproducible tag of a file's state."""
    return F.concat(F.lit('"'), F.lower(F.hex(F.xxhash64(modified, length))), F.lit('"'))


def http_date(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
