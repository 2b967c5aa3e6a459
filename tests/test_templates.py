from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexa.functions import scalars as S
from codexa.functions.templates import format_fields

KIND = "template string, book int, chapter int, alias string"


def filled(spark, templates, book=7, chapter=1234, alias="ab cd"):
    rows = spark.createDataFrame([(i, t, book, chapter, alias) for i, t in enumerate(templates)], f"i int, {KIND}")
    values = {"book": F.col("book"), "chapter": F.col("chapter"), "alias": F.col("alias")}
    return [r.x for r in rows.orderBy("i").select(format_fields(F.col("template"), values, ("book", "chapter")).alias("x")).collect()]


def plainly(template, book=7, chapter=1234, alias="ab cd"):
    try:
        return template.format(book=book, chapter=chapter, alias=alias)
    except Exception:  # noqa: BLE001  every error has the same result
        return None


def test_formats_as_the_language_of_templates_does(spark):
    templates = [
        "", "plain\ntext", "{book}", "{{{book}}}", "{{}}", "{book:03d}/{chapter:>6}", "{alias:*^9}|{alias:.2}|{alias:_<8}", "{alias[0]}{alias[4]}", "{alias[5]}", "{book[0]}", "{book!s:>4}", "{alias!s}", "{book:+d}", "{book: }",
        "{chapter:,}", "{chapter:_}", "{chapter:08,d}", "{chapter:09,d}", "{chapter:010,}", "{chapter:_x}", "{chapter:#x}", "{chapter:#X}", "{chapter:#010b}", "{chapter:o}", "{chapter:n}", "{chapter:x=+9}", "{chapter:<<9}", "{chapter:<09}",
        "{chapter:^9}", "{alias:05}", "{alias:{book}}", "{alias:>{book}}|", "{book:0{book}d}", "{", "}", "{book", "book}", "{book}}", "{{book}", "{}", "{0}", "{unknown}", "{alias:d}", "{book:s}", "{alias:=9}", "{alias:+}", "{alias:#}", "{alias:,}",
        "{book:.2}", "{chapter:,x}", "{chapter:,n}", "{book:Q}", "{book!z}", "{book:}", "{book:}}}", "é{alias:é>8}",
    ]
    assert dict(zip(templates, filled(spark, templates), strict=True)) == {t: plainly(t) for t in templates}
    assert filled(spark, [None]) == [None]
    assert filled(spark, ["{alias}", "{book}"], alias=None) == [None, "7"]


def test_what_is_not_offered_is_an_error(spark):
    assert filled(spark, ["{book.real}", "{alias!r}", "{book:c}", "{book:.1f}", "{book:10000}"]) == [None] * 5


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["book", "chapter", "alias"]), st.from_regex(r"([*0x<]?[<>=^])?[-+ ]?#?0?(\d{1,2})?[,_]?(\.\d)?[sdnboxX]?", fullmatch=True)), min_size=20, max_size=40), st.integers(-(2**31), 2**31 - 1))
def test_any_spec(spark, fields, chapter):
    templates = [f"<{{{name}:{spec}}}>" for name, spec in fields if spec.isascii()]
    assert dict(zip(templates, filled(spark, templates, chapter=chapter), strict=True)) == {t: plainly(t, chapter=chapter) for t in templates}


def test_links(spark):
    rows = spark.createDataFrame([("{book:03d}-{chapter_zerofill_ps3}-{book_alias:>5}-{book_code2}", 19, 7, "ps", None, None), ("{book}", 1, 1, None, "a", "b"), ("{book}", None, 1, "a", "b", "c"), (None, 1, 1, "a", "b", "c"), ("{{{book_alias", 1, 1, "a", "b", "c")], "t string, n int, c int, a string, b string, d string")
    assert [r[0] for r in rows.select(S.expand_template(*map(F.col, "tncabd"))).collect()] == ["019-007-   ps-", "", "", "", ""]
