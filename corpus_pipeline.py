"""The corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but
the last keep the columns of documents; filters keep or drop whole rows, the passage stage rewrites texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm import overlap, packing, quality_mil, quality_rules, substring
from codexa.llm.common import fold, free_name, row_key, set_aside, written
from codexa.llm.queries import table, tokenizer_path

#: Seeds of the near-duplicate stage's random orders.
NEAR_SEEDS = (42, 43, 44, 45)


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep.

    Null, empty and very short texts fail the base rules and go; repeated rows are judged each, alike, and equal texts
    share their fate. All columns stay as they are, whatever they are called. No rows give no rows.
    """
    inner, back = set_aside(docs, "text")
    return back(quality_rules.judge(inner).where("kept"))


def passes_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    It is learned from the labelled rows of the whole table of documents: few bad ones are left among those kept so far.
    Null and empty texts have the score of a text without passages; repeated rows are scored each, alike; a score equal to
    the bound is accepted. All columns stay as they are, whatever they are called. No rows give no rows.
    """
    known = table(spark, sf_dir, "documents").where(fold("doc_id", 5) != 0)
    model = quality_mil.learn(known, table(spark, sf_dir, "labels"))
    inner, back = set_aside(docs, "text")
    return back(quality_mil.score(inner, model, column="_quality").where(F.col("_quality") >= quality_mil.ACCEPT_FROM))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Linked are pairs of which 0.8 of the distinct five-word shingles are common, verified exactly; the SimHash operator
    proposes the first of them, bands of minima and prefixes the rest. A null id comes after all others. Null and wordless
    texts are one group. Of rows with equal ids and equal texts one stays; rows that only share an id are told apart by
    their texts. Any other columns of docs stay as they are. No rows give no rows.
    """
    row = free_name(docs, "_row")
    kept = overlap.near_duplicates(docs, NEAR_SEEDS).where("kept").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key()).join(kept, row, "left_semi").dropDuplicates([row]).select(*[f"`{c}`" for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; texts that lose none stay as they are.

    A null text stays null, an empty one empty; a null id counts as larger than all others; rows with equal ids do not
    cut each other. n_chars follows a text that was cut; all other columns stay, whatever they are called. No rows give no
    rows.
    """
    chars = free_name(docs, "_chars")
    inner, back = set_aside(docs.withColumnRenamed("n_chars", chars), "doc_id", "text", chars)
    cut = F.col("n_removed") > 0
    found = substring.dedup_substrings(inner).withColumn(chars, F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col(chars)))
    return back(found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))).withColumnRenamed(chars, "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their tokens and places in the training sequences.

    Null and empty texts are packed as their end alone; rows with equal or null ids are packed each; other columns are
    ignored. No rows give no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", passes_rules),
    ("quality_classifier", passes_classifier),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]

#: The stages fit models and link components; SQL can't express them, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
