from __future__ import annotations

import numpy as np

from codexa.llm import langid
from tests.llm.conftest import prose


def test_more_than_64_languages_and_long_texts(spark):
    """Each language has its own words; the last one has long texts only."""
    langs = [f"l{i:02d}" for i in range(70)]
    rows = [(3 * i + k, f"{prose(i, 30)} " * (200 if i == 69 else 4), x) for i, x in enumerate(langs) for k in range(3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == tuple(langs)
    right = [langid.identify(model, prose(i, 30))[0] == x for i, x in enumerate(langs)]
    assert sum(right) > 63 and right[69] and sum(right[64:]) >= 5
    slow = langid.fit([(x, t) for _, t, x in rows])
    assert slow.langs == model.langs and (slow.masks == model.masks).all() and (slow.false_rate == model.false_rate).all()


def test_filters_of_spark_are_those_of_memory(spark, odd, odd_rows):
    """Odd rows: null and empty texts aren't learned from, rows with equal id and text count once."""
    slow = langid.fit([(lang, text) for _, text, lang in {r[:3] for r in odd_rows if r[1] and r[2] is not None}])
    model = langid.learn(odd)
    assert slow.langs == model.langs and (slow.masks == model.masks).all()
    few = [(i, prose(i % 2, 20), "ab"[i % 2]) for i in range(8)]
    model = langid.learn(spark.createDataFrame(few, "doc_id long, text string, lang string").repartition(3))
    assert (langid.fit([(x, t) for _, t, x in few]).masks == model.masks).all() and len(np.unique(model.masks)) > 1


def slow_hits(model, text):
    """Hits of each language by testing each n-gram's three bits one by one."""
    words = np.atleast_2d(model.masks)
    of = lambda i, slot: int(words[i // 64, slot]) >> i % 64 & 1
    slots = [[int(x) for x in s] for s in langid._slots(langid.grams(text))]
    return [sum(all(of(i, s[k]) for s in slots) for k in range(len(slots[0]))) for i in range(len(model.langs))]


def test_decision_equals_a_slow_filter():
    for n in (2, 5, 12, 70):
        model = langid.fit([(f"l{i:02d}", f"{prose(i, 25)} " * 4) for i in range(n)])
        for i in range(0, n, 7):
            text = prose(i, 12) + " and more"
            share = [max(0.0, (h / len(langid.grams(text)) - f) / (1 - f)) for h, f in zip(slow_hits(model, text), model.false_rate, strict=True)]
            lang, score = langid.identify(model, text)
            assert lang == model.langs[int(np.argmax(share))] and abs(score - (max(share) / sum(share) if sum(share) else 0)) < 1e-9
