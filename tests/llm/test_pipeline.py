"""The pipeline on planted documents, each stage against a brute-force version of itself."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as C
from codexa.llm import quality_mil, quality_rules
from tests.llm.conftest import CLASHES, SCHEMA, prose
from tests.llm.test_bpe_packing import check_packed
from tests.llm.test_dedup_lm import plain_cut
from tests.llm.test_overlap import plain_groups


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    passage, rng, rows = prose(9000, 60), random.Random(1), []

    def add(text, lang="en"):
        rows.append((len(rows), text, lang, "s", len(text or "")))

    for k in range(90):
        add(prose(k, 120))
    for k in range(20):
        add(" ".join(f"{w.strip('.').upper()}!!" for w in prose(500 + k, 80).split()))
    for k in range(5):
        add(prose(k, 120))  # exact copies
        words = prose(10 + k, 120).split()
        words[rng.randrange(120)] = "changed"
        add(" ".join(words))
    for k in range(6):
        add(f"{prose(600 + k, 70)} {passage} {prose(700 + k, 50)}")
    for text in (None, "", "too short"):
        add(text)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"file://{folder}/documents.parquet")
    labels = [(i, int(not (r[1] or "").isupper()), 0) for i, r in enumerate(rows) if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        got = stage(spark, out[-1], sf_dir)
        if k < len(C.STAGES) - 1:
            assert got.schema.names == docs.schema.names
        got.write.parquet(f"{sf_dir}/stage{k}")
        out.append(spark.read.parquet(f"{sf_dir}/stage{k}"))
    return [df.collect() for df in out]


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_rules_stage(stages, spark, sf_dir):
    kept = set(ids(stages[1]))
    assert kept >= set(range(90)) and not kept & set(range(90, 110)) and not kept & {126, 127, 128}
    judged = quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kept")
    assert ids(judged.collect()) == ids(stages[1])
    before = {r.doc_id: r for r in stages[0]}
    assert all(before[r.doc_id] == r for r in stages[1])


def test_classifier_stage(stages, spark, sf_dir):
    assert set(ids(stages[2])) <= set(ids(stages[1])) and len(set(ids(stages[2])) & set(range(90))) >= 88
    model = quality_mil.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").where("crc32(cast(doc_id AS string)) % 5 <> 0"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stages[2]) == sorted(r.doc_id for r in stages[1] if model.score(r.text) >= quality_mil.ACCEPT_FROM)
    assert all(model.score(r.text) < quality_mil.ACCEPT_FROM for r in stages[0] if (r.text or "").isupper())


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in sorted(stages[2], key=lambda r: r.doc_id)]
    assert ids(stages[3]) == sorted(i for i, g in map(eval, plain_groups(rows)) if i == g)
    assert not set(ids(stages[3])) & set(range(110, 120, 2))  # exact copies are gone
    assert not set(ids(stages[3])) & set(range(111, 120, 2))  # and near ones


def test_texts_of_one_id_are_told_apart(spark, sf_dir):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (1, prose(1, 60)), (2, prose(2, 60)), (None, prose(3, 60)), (None, prose(4, 60)), (None, prose(3, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text) for r in C.one_of_each_group(spark, docs, sf_dir).collect())
    assert got == sorted((str(i), t) for i, t in (rows[0], rows[1], rows[4], rows[5]))


def test_stages_keep_columns_of_any_name(spark, sf_dir, odd):
    names = (*CLASHES, "_t", "_w", "_h", "_s", "_p", "_lines", "_row", "_quality", "quality", "n_removed", "_chars", "_place", "_of", "row", "key")
    mine = odd.select("*", *[F.lit(c).alias(c) for c in dict.fromkeys(names)])
    for _, stage in C.STAGES[:-1]:
        got = stage(spark, mine, sf_dir)
        assert got.columns == mine.columns
        assert all(r[c] == c for r in got.collect() for c in names)
        assert sorted(str(r) for r in got.select(odd.columns).collect()) == sorted(str(r) for r in stage(spark, odd, sf_dir).collect())
    assert C.STAGES[-1][1](spark, mine, sf_dir).count() == C.STAGES[-1][1](spark, odd, sf_dir).count()


def test_passage_stage(stages):
    want = {i: text for i, _, _, text in plain_cut(sorted((r.doc_id, r.text) for r in stages[3]), 13)}
    before = {r.doc_id: r for r in stages[3]}
    assert ids(stages[4]) == ids(stages[3])
    for r in stages[4]:
        unchanged = len(want[r.doc_id].split()) == len(before[r.doc_id].text.split())
        assert r.text == (before[r.doc_id].text if unchanged else want[r.doc_id]) and r.n_chars == (before[r.doc_id].n_chars if unchanged else len(r.text))
    passage = prose(9000, 60)
    assert sum(passage in r.text for r in stages[4]) == 1


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    check_packed(stages[5], [(r.doc_id, r.text) for r in stages[4]], Tokenizer.from_file(C.tokenizer_path()), 4096)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = C.run(spark, sf_dir).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, bytes(r.ids))
    assert sorted(map(key, got)) == sorted(map(key, stages[5]))


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, odd_rows, empty):
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    for k, (_, stage) in enumerate(C.STAGES):
        got = stage(spark, odd, sf_dir).collect()
        assert {r.doc_id for r in got} <= {r[0] for r in odd_rows}
        if k == 3:
            assert len(got) == len(odd_rows)
    assert np.isfinite(len(got))
