from __future__ import annotations

import random

import numpy as np
import pytest

from codexa.llm import odd_sketch as O
from codexa.llm import overlap
from tests.llm.conftest import prose


def word_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(rows):
    """id, size, component and kept by comparing all pairs of word sets."""
    sets = [word_sets(r[1]) for r in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    least = {c: min((r[0] for r, x in zip(rows, of, strict=True) if x == c and r[0] is not None), default=None) for c in of}
    return sorted(str((r[0], len(s), least[c], r[0] == least[c])) for r, s, c in zip(rows, sets, of, strict=True))


def found(docs, **more):
    return sorted(str(tuple(r)) for r in O.near_duplicates(docs, **more).collect())


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"w{rng.random()}" if rng.random() < share else w for w in text.split())


def test_equals_brute_force(spark, odd, odd_rows):
    assert found(odd) == slow(odd_rows)


def test_chains_and_bounds(spark):
    """Chains of small edits, pairs on both sides of the bound, copies that differ in case and space."""
    rows, text = [], prose(11, 200)
    for i in range(25):
        rows.append((100 - i, text))
        text = edited(text, i, 0.012)
    words = [f"t{i}" for i in range(104)]  # 100 shingles; a changed end takes one away and adds one
    rows += [(200 + k, " ".join(words[:-k] + [f"z{k}{j}" for j in range(k)] if k else words)) for k in range(12)]
    rows += [(300, "One TWO\tthree"), (301, "one two three "), (302, "one two four"), (303, "ÄÖ one"), (304, "äö one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df) == slow(rows)


def test_a_large_group_of_near_copies(spark):
    """Copies that are each within the bound of the first, but not of each other, are one component."""
    base = prose(12, 150)
    rows = [(0, base)] + [(i, edited(base, i, 0.017)) for i in range(1, 150)] + [(1000 + i, prose(100 + i, 60)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found(df) == slow(rows)


def test_pairs_that_bands_leave_apart_are_joined_by_prefixes(spark, monkeypatch):
    """Without rounds of comparisons with one text, prefixes alone find all links."""
    monkeypatch.setattr(overlap, "ROUNDS", 0)
    base = prose(13, 120)
    rows = [(i, edited(base, i, 0.01)) for i in range(40)] + [(100 + i, edited(base, 99 + i, 0.2)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(df) == slow(rows)


def test_columns_of_any_name(spark, clashing, odd_rows):
    df = clashing.withColumnRenamed("text", "y.b").withColumnRenamed("doc_id", "x.id")
    assert found(df, id_col="x.id", text="y.b") == slow(odd_rows)


def test_no_rows(empty):
    assert O.near_duplicates(empty).count() == 0


def test_sketch_is_the_parity_of_the_sample():
    least = np.arange(O.SAMPLES, dtype=np.uint64)
    bits = np.unpackbits(O.odd_sketch(least), bitorder="little")
    single = sum(np.unpackbits(O.odd_sketch(least) ^ O.odd_sketch(np.where(np.arange(O.SAMPLES) == i, least + np.uint64(1), least)), bitorder="little").sum() for i in range(20))
    assert bits.sum() % 2 == O.SAMPLES % 2 and single <= 40


@pytest.mark.parametrize("share", [0.6, 0.8, 0.85, 0.9, 0.97])
def test_estimate(share):
    rng, off = np.random.default_rng(int(100 * share)), []
    for _ in range(60):
        n = 400
        both = round(2 * n * share / (1 + share))
        drawn = rng.integers(0, 1 << 64, 2 * n - both, np.uint64)
        a, b = O.minima(drawn[:n]), O.minima(drawn[n - both :])
        ones = np.unpackbits(O.odd_sketch(a) ^ O.odd_sketch(b)).sum()
        off.append(O.estimate(ones) - both / (2 * n - both))
        assert share < 0.85 or ones <= O.most_ones()
    assert abs(np.mean(off)) < 0.02 and np.std(off) < (0.08 if share < 0.8 else 0.05)
