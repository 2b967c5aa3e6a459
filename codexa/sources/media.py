"""Narration files on disk, as listings and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codexa.sources.tables import schema

_PATH = r"/([^/]+)/([^/]+)/mp3/([^/]+)/([^/]+)\.mp3$"


def audio_listing(spark: SparkSession, base: str) -> DataFrame:
    """Books and chapters below base/{translation}/{voice}/mp3/{book}/{chapter}.mp3, each once (a chapter may be named 1 or 01).

    Folders and files whose names aren't numbers are skipped; a missing base has no files. Contents aren't read.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp3").load(base).select("path", "length")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema("audio_files"))
    part = lambda i: F.regexp_extract("path", _PATH, i)
    out = files.select(part(1).alias("translation_alias"), part(2).alias("voice_alias"), part(3).try_cast("int").alias("book"), part(4).try_cast("int").alias("chapter"), "length")
    return out.where("book IS NOT NULL AND chapter IS NOT NULL").groupBy("translation_alias", "voice_alias", "book", "chapter").agg(F.max("length").alias("length"))


def file_stats(spark: SparkSession, base: str) -> DataFrame:
    """path, modificationTime and length of the files below a folder, whatever its depth, but for empty ones, which Spark's readers skip; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "modificationTime", "length")
