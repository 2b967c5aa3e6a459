"""The jobs as queries: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.plans.oracle import overview, with_tables
from codexa.plans.queries import AS_OF, NOW
from codexa.sources.scratch import scratch
from jobs import import_texts, request_rollup


def job1_request_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "job1")
    for _ in range(2):
        request_rollup.run(spark, f"{sf_dir}/events.parquet*", f"{base}/out", f"{base}/checkpoint", AS_OF, NOW)
    return request_rollup.result(spark, f"{base}/out", NOW)


def job2_import_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "job2")
    for _ in range(2):
        import_texts.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out")
    return import_texts.result(spark, f"{base}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_request_rollup": job1_request_rollup, "job2_import_texts": job2_import_texts}


_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
TEXTS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, 'und') AS language, coalesce(lang, 'und') || '-' || coalesce(source, 'none') AS edition, string_split(text, chr(10)) AS lines FROM documents),
     lines AS (SELECT row, generate_subscripts(lines, 1) AS i, trim(unnest(lines), {_BLANKS}) AS text FROM docs),
     paragraphs AS (SELECT row, i, text, coalesce(lag(text) OVER (PARTITION BY row ORDER BY i), '') = '' AS start_paragraph FROM lines),
     verses AS (SELECT row, text, start_paragraph, CAST(row_number() OVER (PARTITION BY row ORDER BY i) AS INT) AS verse_number, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS html FROM paragraphs WHERE text <> ''),
     counts AS (SELECT d.row, d.edition, d.language, count(v.row) AS n FROM docs d LEFT JOIN verses v ON v.row = d.row GROUP BY ALL),
     editions AS (SELECT edition, min(language) AS language, count(*) AS documents, count(*) FILTER (n = 0) AS documents_without_text, CAST(sum(n) AS BIGINT) AS verses FROM counts GROUP BY edition)
SELECT d.edition, d.doc_id, v.verse_number, v.text, v.html, v.start_paragraph, e.language, e.documents, e.documents_without_text, e.verses
FROM docs d JOIN editions e ON e.edition = d.edition LEFT JOIN verses v ON v.row = d.row
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_request_rollup": with_tables(overview()), "job2_import_texts": TEXTS_SQL}
