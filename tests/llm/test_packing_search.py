from __future__ import annotations

import random

import pytest

import corpus_pipeline as C
from codexa.llm import packing
from tests.llm.conftest import prose
from tests.llm.test_bpe_packing import check_bins


def full_sequences(seed, n, capacity, least, most):
    """Documents that fill n sequences without waste, of least to most documents each."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        cuts = sorted(rng.sample(range(1, capacity), rng.randint(least, most) - 1))
        out += [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]
    rng.shuffle(out)
    return out


def test_a_partner_below_an_equal_one():
    lengths = [5, 5, 5, 6, 6, 10]
    bins = packing.complete_bins(lengths, 20)
    check_bins(lengths, bins, 20)
    assert len(bins) == 2


@pytest.mark.parametrize("least, most, capacity", [(3, 4, 1000), (5, 7, 100)])
def test_sequences_of_many_documents(least, most, capacity):
    spare = better = 0
    for seed in range(20):
        lengths = full_sequences(seed, 12, capacity, least, most)
        bins = packing.complete_bins(lengths, capacity)
        check_bins(lengths, bins, capacity)
        spare += len(bins) - 12
        better += len(packing.best_fit(lengths, capacity)) - len(bins)
    assert better > 0 and spare <= 5


@pytest.mark.parametrize("least, most", [(3, 4), (5, 7)])
def test_chunk_sized_inputs_are_searched(least, most):
    lengths = full_sequences(5, 800, 4096, least, most)
    bins = packing.complete_bins(lengths, 4096)
    check_bins(lengths, bins, 4096)
    assert len(packing.best_fit(lengths, 4096)) > len(bins) == 800


@pytest.mark.parametrize("parts", [1, 16, 64])
def test_sequences_do_not_follow_the_partitions(spark, parts):
    docs = spark.createDataFrame([(i, prose(i, 40 + 17 * i % 900)) for i in range(128)], "doc_id long, text string").repartition(parts)
    rows = packing.pack_documents(docs, C.tokenizer_path()).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) and {r.doc_id for r in rows} == set(range(128))
    assert len({r.sequence_id for r in rows}) <= packing.lower_bound([r.length for r in rows], packing.CAPACITY) + 1
