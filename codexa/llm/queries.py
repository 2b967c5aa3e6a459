"""The thin queries over the operators of this subpackage; each derives the columns of its contract from real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm import arc_convert, bpe, hard_negatives, jpeg, langid, lm_mix, odd_sketch, packing, quality_mil, quality_rules, simhash, substring
from codexa.llm.common import fold, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.learn(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = quality_mil.score(docs, model)
    predicted = (F.col("score") >= quality_mil.ACCEPT_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", predicted)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = arc_convert.convert(table(spark, sf_dir, "pages"), "page_id", "url", "html", payloads=False)
    return read.select(F.col("number").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_number").alias("refers_to"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are written to the shared folder; all columns, the tensors' digest too, are of what is read back from there."""
    media = written(jpeg.store(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media"), "media", codec="zstd")
    read = jpeg.load(media, tensors=False)
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "rgb_sha256",
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(fold("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_lm_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_mix.score(docs, fold("doc_id", 10) != 0)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 256)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.mine(rows.withColumn("label", label), F.col("id") % 50 == 0)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_mil": op1_quality_mil, "op2_warc": op2_warc, "op3_bpe": op3_bpe, "op4_simhash": op4_simhash, "op5_jpeg": op5_jpeg, "op6_langid": op6_langid, "op7_lm_mix": op7_lm_mix, "op8_quality_rules": op8_quality_rules, "op9_substring": op9_substring, "op10_packing": op10_packing, "op11_hard_negatives": op11_hard_negatives, "op12_odd_sketch": op12_odd_sketch}


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
     f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
"""


OP11_SQL = """
WITH known AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
       FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.id AS anchor_id, a.label = r.label AS same, r.id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
       FROM known a JOIN known r ON a.id % 50 = 0 AND a.id <> r.id),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op11_hard_negatives": OP11_SQL}
