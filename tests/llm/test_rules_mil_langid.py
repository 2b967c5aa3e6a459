from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import langid, quality_mil, quality_rules
from codexa.llm.common import fold
from tests.llm.conftest import SF, prose, shown

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, clashing):
    more = spark.createDataFrame([(100, "a b c d e a b c d e f"), (101, "x x x x x x x"), (102, "l\n\nl\n \nm\nl"), (103, "a#b *$% 𝒳𝒳\x85y é"), (104, "a b c d e " * 300)], "doc_id int, text string")
    for df in (odd, clashing, more):
        for r in quality_rules.judge(df).collect():
            assert tuple(r[c] for c in BASE) == brute(r.text)
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (r.kept is False or not r.base_failed)


def test_rules_tables(odd, empty, clashing):
    judged = quality_rules.judge(odd)
    assert judged.count() == 15 and quality_rules.judge(empty).count() == 0
    assert {r.source for r in quality_rules.judge(clashing).where("doc_id = 1").collect()} == {"a"} and {r.words for r in quality_rules.judge(clashing).collect()} == {"mine"}
    assert "text" not in quality_rules.judge(odd, keep_text=False).columns
    assert shown(judged.where("doc_id = 2").distinct(), "doc_id", "kept").__len__() == 1


def test_fit_and_posterior():
    n = len(quality_rules.RULES)
    good, bad, rare = (1,) * n, (-1, -1, 1, -1) + (1,) * (n - 4), (1,) * (n - 1) + (0,)
    model = quality_rules.fit([(good, 900), (bad, 80), (rare, 20)])
    assert quality_rules.posterior(good, model) > 0.99 and quality_rules.posterior(bad, model) < 0.05 and quality_rules.posterior(rare, model) > 0.9
    start = quality_rules.fit([])
    assert start.good == pytest.approx(quality_rules.START_GOOD) and set(start.on_good) == {quality_rules.START_ON_GOOD}


def test_sql_and_driver_agree_on_the_posterior(spark):
    docs = spark.createDataFrame([(i, prose(i, 80) if i % 5 else "AB!! CD!! EF!! " * 20) for i in range(60)], "doc_id int, text string")
    judged = quality_rules.judge(docs).collect()
    votes = [tuple(r[f"vote_{x}"] for x in quality_rules.RULES) for r in judged]
    model = quality_rules.fit(sorted(Counter(votes).items()))
    for r, v in zip(judged, votes, strict=True):
        assert r.quality == pytest.approx(quality_rules.posterior(v, model), abs=1e-9)


def test_no_python_in_the_plan(odd):
    plan = quality_rules.measured(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@needs_tables
def test_rules_against_labels(spark):
    sf = SF.replace("0.001", "0.01")
    judged = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), keep_text=False).withColumnRenamed("quality", "posterior")
    both = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    clean, junk = [r.kept for r in both if r.quality == 1], [r.kept for r in both if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2


@needs_tables
def test_classifier_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_mil.learn(docs.where(fold("doc_id", 5) != 0), labels)
    got = quality_mil.score(docs.where(fold("doc_id", 5) == 0), model).join(labels, "doc_id").collect()
    right = [(r.score >= quality_mil.ACCEPT_FROM) == (r.quality == 1) for r in got]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality_mil.WIDTH)) for k in (1, 3, 2)]
    model = quality_mil.train([b.astype(np.float32) for b in bags], np.array([1, 0, 1]))
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0, 1])

    def loss():
        s, _ = model.forward(x, starts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in model.gradient(x, starts, y).items():
        at = tuple(rng.integers(0, n) for n in model.weights[k].shape)
        kept = model.weights[k][at]
        model.weights[k][at] = kept + 1e-5
        up = loss()
        model.weights[k][at] = kept - 1e-5
        down = loss()
        model.weights[k][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_classifier_tables(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (6, 1, 0), (8, 0, 0), (None, 1, 0), (11, None, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_mil.learn(odd, labels)
    scored = quality_mil.score(clashing, model).collect()
    assert len(scored) == 15 and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in quality_mil.score(odd, quality_mil.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert quality_mil.learn(empty, labels) is None and quality_mil.score(empty, model).count() == 0
    assert quality_mil.passages(None).shape == quality_mil.passages(" ").shape == (1, quality_mil.WIDTH) and len(quality_mil.passages("a " * 161)) == 3


@needs_tables
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = langid.learn(docs.where(fold("doc_id", 3) != 1))
    got = langid.predict(docs.where(fold("doc_id", 3) == 1), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_filters_contain_what_they_learned():
    model = langid.fit([("aa", "lorem ipsum " * 9), ("bb", "dolor amet " * 9)])
    assert langid.identify(model, "LOREM, ipsum!")[0] == "aa" and langid.identify(model, "amet")[0] == "bb"
    a, b, c = langid._slots(langid.grams("lorem ipsum lorem"))
    assert ((model.masks[a] & model.masks[b] & model.masks[c]) & 1).all()
    many = langid.fit([(f"l{i:02d}", f"{prose(i, 30)} " * 4) for i in range(40)])
    assert many.masks.dtype == np.uint64 and np.mean([langid.identify(many, prose(i, 30))[0] == f"l{i:02d}" for i in range(40)]) > 0.9


def test_language_tables(odd, empty, clashing):
    model = langid.learn(odd)
    rows = langid.predict(clashing, model).collect()
    assert len(rows) == 15
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (not letters or r.lang_pred in {"en", "fr", "de", "es"})
    nothing = langid.learn(odd.where(F.lit(False)))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(empty, model).count() == 0
    assert langid.identify(model, "12 34 --") == ("und", 0.0)
