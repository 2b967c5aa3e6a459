"""Narration files: listing, link templates, path checks and byte ranges."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.functions import scalars as S

#: Bytes of a file that one row of read_ranges holds at most.
SPLIT = 4 << 20


def voice_link_templates(requests: DataFrame, voices: DataFrame, translations: DataFrame) -> DataFrame:
    """requests (translation_alias, voice_alias) with link_template; '' where no active pair has one."""
    v = voices.where("active = 1").select(F.col("alias").alias("voice_alias"), F.col("translation").alias("code"), "link_template")
    t = translations.where("active = 1").select(F.col("alias").alias("translation_alias"), "code")
    found = v.join(t, "code").groupBy("translation_alias", "voice_alias").agg(F.min("link_template").alias("link_template"))
    return requests.join(found, ["translation_alias", "voice_alias"], "left").withColumn("link_template", F.coalesce("link_template", F.lit("")))


def audio_urls(requests: DataFrame, canon: DataFrame) -> DataFrame:
    """requests (link_template, book, chapter) with url, the template filled from the canon's row of the book.

    Filling is dear, so each template is filled once for a book and chapter, however many requests ask for it.
    """
    key = ["link_template", "book", "chapter"]
    c = canon.select(F.col("number").alias("book"), F.col("number").alias("known"), "code1", "code2", "code3")
    url = F.when(F.col("link_template") == "", "").otherwise(S.expand_template(F.col("link_template"), F.col("known"), F.col("chapter"), F.col("code1"), F.col("code2"), F.col("code3")))
    filled = requests.select(key).distinct().join(F.broadcast(c), "book", "left").select(*key, url.alias("url"))
    return requests.join(filled, key, "left").select(requests["*"], F.coalesce("url", F.lit("")).alias("url"))  # a null in the key gives ''


def check_paths(requests: DataFrame) -> DataFrame:
    """requests (translation, voice, book, chapter) with the first unsafe parameter, or the relative path."""
    unsafe = S.unsafe_parameter(**{c: F.col(c) for c in ("translation", "voice", "book", "chapter")})
    path = F.concat_ws("/", "translation", "voice", F.lit("mp3"), "book", F.concat("chapter", F.lit(".mp3")))
    return requests.withColumn("unsafe", unsafe).withColumn("path", F.when(F.col("unsafe").isNull(), path))


def serve(files: DataFrame, header: Column, size: Column, modified: Column | None = None) -> DataFrame:
    """files with status (200 whole, 206 part, 416 no such range), first and last byte, content_range and content_length.

    With the time of its last change each answer that has bytes also tells it (last_modified) and an entity tag.
    """
    span = S.byte_range(header, size)
    whole = header.isNull() | (header == "")
    out = files.withColumn("_span", F.when(~whole, span))
    status = F.when(whole, 200).when(F.col("_span").isNull(), 416).otherwise(206)
    tags = [] if modified is None else [F.when(status != 416, S.http_date(modified)).alias("last_modified"), F.when(status != 416, S.etag(modified, size)).alias("etag")]
    return out.select(
        files["*"], status.alias("status"),
        F.col("_span.start").alias("first_byte"), F.col("_span.end").alias("last_byte"),
        F.when(~whole, S.content_range(F.col("_span"), size)).alias("content_range"),
        F.when(whole, size).otherwise(F.col("_span.end") - F.col("_span.start") + 1).alias("content_length"), *tags,
    )


def _opened(path: str):
    """A file by its path as Spark shows it, on any file system that pyarrow knows, for reading at positions."""
    scheme, inner = path.split(":", 1) if re.match(r"\w+:", path) else ("file", path)
    inner = inner if inner.startswith("//") else f"//{inner}"
    system, inner = pafs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(inner, safe='/:@')}")
    return system.open_input_file(inner)


def read_ranges(served: DataFrame, path: str = "path", split: int = SPLIT) -> DataFrame:
    """The bytes that serve() describes, read at their positions: served with chunk (from 0), of chunks, and body.

    No more of a file is read than asked for. A range of over `split` bytes comes as several chunks, each a row that any task
    may read. A request without bytes (416, an empty file) has one row without a body. All other columns stay.
    """
    start, size = F.coalesce("first_byte", F.lit(0)), F.when(F.col("status") != 416, F.col("content_length"))
    chunks = F.greatest(F.lit(1), F.coalesce(F.ceil(size / split), F.lit(1)))
    parts = served.select("*", chunks.cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))).alias("chunk"))
    offset = F.col("chunk").cast("long") * split
    parts = parts.select("*", (start + offset).alias("_at"), F.when(size.isNotNull(), F.least(size - offset, F.lit(split))).alias("_length"))
    parts = parts.repartition(F.col(path), F.col("chunk"))  # the chunks of a large file, and the requests of a file, each go together
    kind = T.StructType([*parts.drop("_at", "_length").schema.fields, T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("_at", "_length")]
            asked = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (path, "_at", "_length")), strict=True)
            bodies, held, first = [], 0, 0
            for i, (own, at, length) in enumerate(asked):
                body = None
                if length and own is not None:
                    if own != name:
                        name, file = own, _opened(own)
                    file.seek(at)
                    body = file.read(length)
                bodies.append(body)
                held += length or 0
                if held >= 2 * split or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(bodies, pa.binary())], names=kind.names)
                    bodies, held, first = [], 0, i + 1

    return parts.mapInArrow(run, kind)
