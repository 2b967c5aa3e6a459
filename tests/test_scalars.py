from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexa.functions import scalars as S
from codexa.functions.documents import collapse_nullable, dump


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x")).alias("y")).collect()]


def test_references(spark):
    texts = ["jhn 3:16-17", "gen 1", "Gen 2:4", "1 john 3:16", "gen 1 22 3", "gen 1:5-3", "gen 1:5-0", "", None]
    got = column(spark, texts, S.parse_references)
    assert [[tuple(p)[:4] for p in parts] if parts is not None else None for parts in got] == [
        [("jhn", 3, "16", "17")], [("gen", 1, None, None)], [("en", 2, "4", None)], [("john", 3, "16", None)], [("gen", 1, None, None), ("22", 3, None, None)], [("gen", 1, "5", "3")], [("gen", 1, "5", "0")], [], None,
    ]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[a-z]{2,4}", fullmatch=True), st.integers(1, 150), st.none() | st.integers(1, 99)), min_size=1, max_size=4))
def test_references_round_trip(spark, parts):
    text = "; ".join(f"{b} {c}" + (f":{v}" if v else "") for b, c, v in parts)
    assert [(p.book, p.chapter, p.start_text) for p in column(spark, [text], S.parse_references)[0]] == [(b, c, str(v) if v else None) for b, c, v in parts]


def test_verse_bounds_and_label(spark):
    rows = spark.createDataFrame([("5", "0"), ("5", None), ("5", "3"), ("5", "5"), (None, None)], "s string, e string")
    assert [tuple(r) for r in rows.select(*S.verse_bounds(F.col("s"), F.col("e")), S.range_label(F.col("s"), F.col("e"))).collect()] == [(5, 5, "5-0"), (5, 5, "5"), (5, 3, "5-3"), (5, 5, "5"), (None, None, None)]


def test_numbers_beyond_all_integers(spark):
    part = column(spark, ["b1 99999999999:99999999999-088888888888"], S.parse_references)[0][0]
    assert (part.chapter, part.chapter_text) == (None, "99999999999")
    rows = spark.createDataFrame([(part.start_text, part.end_text), ("3", "99999999999")], "s string, e string")
    assert [tuple(r) for r in rows.select(*S.verse_bounds(F.col("s"), F.col("e"))).collect()] == [(2**31 - 1, 2**31 - 1), (3, 2**31 - 1)]
    assert column(spark, ["99999999999.1"], lambda x: S.update_type(x, F.lit("3.4"), F.lit("5"))) == ["none"]


def test_zero_fill(spark):
    assert column(spark, [5, 119, None], lambda x: S.zero_fill(x, 2), "int") == ["05", "119", None]


def test_timing(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "b double, e double")
    assert [tuple(r) for r in rows.select(*S.timing(F.col("b"), F.col("e"))).collect()] == [(1.0, 2.0), (0.0, 0.0), (0.0, 0.0)]


def test_templates(spark):
    def fill(template, number, chapter):
        rows = spark.createDataFrame([(template, number, chapter, "ps", None, "psa")], "t string, n int, c int, a string, b string, d string")
        return rows.select(S.expand_template(*map(F.col, "tncabd"))).first()[0]

    assert fill("{book_zerofill}/{chapter_zerofill_ps3}", 19, 5) == "19/005"
    assert fill("{book_zerofill}/{chapter_zerofill_ps3}", 18, 5) == "18/05"
    assert fill("{book}-{chapter}-{book_alias}-{book_alias_upper}-{book_code2}-{book_code3}", 7, 119) == "7-119-ps-PS--psa"
    assert fill("{chapter_zerofill3}", 7, 5) == "005"
    assert fill("{nothing}", 7, 5) == fill("a}", 7, 5) == fill("x", None, 5) == fill(None, 7, 5) == ""


def reference_range(header: str, size: int):
    m = re.match(r"bytes=([^,]*)", header)
    if not m or "-" not in m[1]:
        return None
    a, b = m[1].split("-", 1)
    if not re.fullmatch(r"-?\d*", a) or not re.fullmatch(r"-?\d+|", b):
        return None
    start, end = max(0, int(a or 0)), min(size - 1, int(b) if b else size - 1)
    return (start, end) if start <= end else None


def test_byte_ranges(spark):
    headers = ["bytes=0-9", "bytes=-50", "bytes=90-", "bytes=5-2", "bytes=0-5,7-9", "bytes=a-b", "items=0-1", "bytes=0-999", "bytes=", "bytes=7", "bytes=1--1", "bytes=-"]
    for size in (100, 0):
        got = column(spark, headers, lambda x, n=size: S.byte_range(x, F.lit(n).cast("bigint")))
        assert [tuple(g) if g else None for g in got] == [reference_range(h, size) for h in headers]


def test_versions(spark):
    kinds = lambda least, latest: column(spark, ["1", "1.1", "1.1.0", "1.10", "1.9"], lambda x: S.update_type(x, F.lit(least), F.lit(latest)))
    assert kinds("1.1", "1.1") == ["hard", "none", "none", "none", "none"]
    assert kinds("1.1", "1.10") == ["hard", "soft", "soft", "none", "soft"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["x"], S.version)


def test_endpoints(spark):
    paths = ["/api/audio/a/b.mp3", "/api/audio/", "/api/translations/12/books", "/api/translations/x/books", "/x/api/audio/a", "/api/translations/1/books/more"]
    assert column(spark, paths, S.normalize_endpoint) == ["/api/audio/*", "/api/audio/", "/api/translations/*/books", "/api/translations/x/books", "/x/api/audio/a", "/api/translations/*/books"]


def test_client_and_agent(spark):
    rows = spark.createDataFrame([(" 1.1.1.1 , 2.2.2.2", "p"), ("", "p"), (None, None)], "f string, p string")
    assert [r[0] for r in rows.select(S.client_ip(F.col("f"), F.col("p"))).collect()] == ["1.1.1.1", "p", "unknown"]
    assert column(spark, ["x" * 600, None], lambda x: F.length(S.user_agent(x))) == [512, 0]
    assert column(spark, [1.9999, -0.0015], S.elapsed_ms, "double") == [1999, -1]


def test_numbers_to(spark):
    assert column(spark, [3, 0, -1, None], S.numbers_to, "int") == [[1, 2, 3], [], [], []]


def test_unsafe_parameters(spark):
    rows = spark.createDataFrame([("a", "b"), ("a/", ".."), ("a", "b\\c"), ("a", "x..y")], "t string, v string")
    assert [r[0] for r in rows.select(S.unsafe_parameter(translation=F.col("t"), voice=F.col("v"))).collect()] == [None, "translation", "voice", "voice"]


def test_documents(tmp_path):
    twice = {"x": {"anyOf": [{"type": "string"}, {"type": "string", "format": "d"}, {"type": "null"}, 5]}}
    assert collapse_nullable(twice) == {"x": {"type": "string"}}
    root = {"anyOf": [{"type": "string"}, {"type": "null"}]}
    assert collapse_nullable(root) == root and collapse_nullable([root]) == [root]
    doc = {"a": {"anyOf": [{"type": "string"}, {"type": "null"}], "items": 1, "title": "A"}, "b": [{"anyOf": [{"type": "string"}, {"type": "integer"}, {"type": "null"}]}], "c": {"anyOf": [{"$ref": "x"}, {"type": "null"}]}}
    assert collapse_nullable(doc) == {"a": {"type": "string", "items": 1, "title": "A"}, "b": [{"anyOf": [{"type": "string"}, {"type": "integer"}, {"type": "null"}]}], "c": {"type": None}}
    dump({"b": [1, {"c": "x"}], "a": {}}, str(tmp_path / "x.yaml"))
    assert (tmp_path / "x.yaml").read_text() == 'b:\n  - 1\n  -\n    c: "x"\na: {}\n'
    dump({"b": 1}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == '{\n  "b": 1\n}'
