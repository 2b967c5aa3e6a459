"""Imports a table of texts as editions, one for each language and source, and replaces only the editions that have changed.

    spark-submit jobs/import_texts.py --documents PATH --out FOLDER [--config FILE]

--documents is a Parquet table (doc_id, text, lang, source). FOLDER/verses/edition=... holds each text's lines as numbered
verses with their markup; a text without any word has one row without a verse, so it can be found as a gap.
FOLDER/editions/edition=... holds a row of totals and the digest of what was imported. An edition is imported again where
its digest differs and dropped where the table has it no more; digests are written last, so a run that ended half way is
made good by the next, and the same input again changes nothing.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codexa.operators import sync
from codexa.sources import partitions

#: What separates words, and what markup must escape.
BLANKS = " \t\x0b\x0c\r"
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
DOCUMENTS = "doc_id bigint, text string, lang string, source string"
VERSES = "doc_id bigint, verse_number int, text string, html string, start_paragraph boolean, edition string"
EDITIONS = "language string, documents bigint, documents_without_text bigint, verses bigint, rows bigint, digest string, edition string"
log = logging.getLogger("import_texts")


def verses_of(text: Column) -> Column:
    """The lines of a text that have a word, as an array of (text, start_paragraph); a paragraph starts after a line without one."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    numbered = F.zip_with(lines, F.concat(F.array(F.lit("")), lines), lambda x, before: F.struct(x.alias("text"), (before == "").alias("start_paragraph")))
    return F.filter(numbered, lambda v: v["text"] != "")


def verses(docs: DataFrame) -> DataFrame:
    """docs (edition, doc_id, text) as verses, numbered from 1; a text without any, or null, has one row without a verse."""
    rows = docs.select("edition", "doc_id", F.posexplode_outer(verses_of(F.col("text"))).alias("at", "verse"))
    html = F.col("verse.text")
    for plain, escaped in ESCAPES.items():
        html = F.replace(html, F.lit(plain), F.lit(escaped))
    return rows.select("doc_id", (F.col("at") + 1).alias("verse_number"), "verse.text", F.concat(F.lit("<p>"), html, F.lit("</p>")).alias("html"), "verse.start_paragraph", "edition")


def run(spark: SparkSession, documents: str, out: str, language: str = "und", source: str = "none") -> dict:
    """Brings the editions up to date; what it read and wrote. language and source stand for those that a row lacks."""
    docs = spark.read.schema(DOCUMENTS).parquet(documents).select("doc_id", "text", F.coalesce("lang", F.lit(language)).alias("language"), F.coalesce("source", F.lit(source)).alias("source"))
    docs = docs.select("doc_id", "text", "language", F.concat_ws("-", "language", "source").alias("edition"))
    stored = partitions.read(spark, f"{out}/editions", EDITIONS)
    found = sync.compared(sync.digests(docs.select("edition", "doc_id", "text", "language"), "edition"), stored, "edition").collect()  # a row an edition
    again, gone = [r for r in found if r.state == "changed"], sorted(r.edition for r in found if r.state == "gone")
    read = sum(r.rows or 0 for r in found)
    log.info("read %d documents from %s: %d editions to import, %d to drop", read, documents, len(again), len(gone))
    written = 0
    if again:
        names = spark.createDataFrame([(r.edition, r.rows, r.digest) for r in again], "edition string, rows bigint, digest string")
        wrote = Observation()
        fresh = verses(docs.join(F.broadcast(names.select("edition")), "edition", "left_semi"))
        partitions.replace(fresh.observe(wrote, F.count_if(F.col("verse_number").isNotNull()).alias("verses")), f"{out}/verses", "edition")
        written = wrote.get["verses"]
        totals = docs.join(F.broadcast(names), "edition").groupBy("edition", "rows", "digest").agg(
            F.min("language").alias("language"), F.count(F.lit(1)).alias("documents"), F.count_if(F.size(verses_of(F.coalesce("text", F.lit("")))) == 0).alias("documents_without_text"), F.sum(F.size(verses_of(F.coalesce("text", F.lit(""))))).alias("verses"),
        )
        partitions.replace(totals.select(*[c.split()[0] for c in EDITIONS.split(", ")]), f"{out}/editions", "edition")
    partitions.drop(spark, f"{out}/verses", VERSES, gone, "edition")
    partitions.drop(spark, f"{out}/editions", EDITIONS, gone, "edition")
    log.info("wrote %d verses of %d editions to %s, dropped %d editions", written, len(again), out, len(gone))
    return {"documents": read, "imported": sorted(r.edition for r in again), "verses": written, "dropped": gone}


def result(spark: SparkSession, out: str) -> DataFrame:
    """The output as it stands: every verse, and every text without one, beside the totals of its edition."""
    totals = partitions.read(spark, f"{out}/editions", EDITIONS).drop("rows", "digest")
    return partitions.read(spark, f"{out}/verses", VERSES).join(F.broadcast(totals), "edition")


if __name__ == "__main__":
    from jobs.common import command_line

    command_line("import_texts", "import_texts.json", {"documents": "table of texts", "out": "output folder"}, run)
