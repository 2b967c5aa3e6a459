from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import hard_negatives as H

SCHEMA = "id bigint, label bigint, vector array<bigint>"


def slow(rows, every=5, positives=5, negatives=3, low=50, high=95):
    """The same by sorting all scores of each anchor."""
    known = sorted({(i, label, tuple(v)) for i, label, v in rows if label is not None and v is not None}, key=str)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, v in known:
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, m == label) for j, m, w in known if j != i]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for score, j, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and low * score <= 100 * x[0] <= high * score]
            out += [(i, j, rank, m, score, s) for rank, (s, m, _) in enumerate(inside[:negatives], 1)]
    return sorted(map(str, out))


def mined(spark, rows, parts=4, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(str(tuple(r)) for r in H.mine(df, F.col("id") % 5 == 0, **sizes).collect())


def clustered(seed, n, dim=8, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 60, (6, dim))
    return [(i, int(rng.integers(labels)), [int(x) for x in centres[rng.integers(6)] + rng.integers(-9, 10, dim)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"shard": 16, "slab": 7, "bucket": 4}), (3, {"shard": 40, "slab": 100, "bucket": 2})])
def test_equals_brute_force(spark, seed, sizes):
    rows = clustered(seed, 300)
    assert mined(spark, rows, **sizes) == slow(rows)


def test_ties_zero_and_negative_scores(spark):
    """Small components make many equal scores, also of zero and below."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), [int(x) for x in rng.integers(-1, 2, 3)]) for i in range(200)]
    assert mined(spark, rows, shard=16, slab=5, bucket=4) == slow(rows)


def test_hot_vector(spark):
    """A vector that most rows share fills many shards of one leaf."""
    rows = clustered(5, 60) + [(100 + i, i % 2, [9] * 8) for i in range(240)]
    assert mined(spark, rows, shard=16, slab=9, bucket=4) == slow(rows)


def test_odd_rows(spark):
    """Nulls, empty and short vectors, repeated rows, equal ids, an anchor without an id."""
    rows = clustered(6, 60) + [(61, None, [1] * 8), (62, 1, None), (65, 1, []), (70, 2, [3]), (None, 1, [40] * 8), (None, 1, [40] * 8), (75, 0, [20] * 8), (75, 0, [20] * 8), (75, 1, [21] * 8)]
    assert mined(spark, rows, shard=16, slab=5, bucket=4) == slow(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine(empty, F.col("id") % 5 == 0).count() == 0
    assert H.mine(spark.createDataFrame([(1, 1, [1])], SCHEMA), F.col("id") % 5 == 0).count() == 0


def test_too_long_a_vector_is_refused(spark):
    with pytest.raises(Exception, match="2\\^53"):
        mined(spark, [(0, 1, [1 << 30])])


def test_scaled_leaves_out_what_is_not_finite(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0]), (3, 1, None), (4, 1, [float("nan")]), (5, 1, [float("inf")]), (6, 1, [1.0, None]), (7, 1, []), (8, 2, [-0.0])]
    df = spark.createDataFrame(rows, "key int, kind int, `a.b` array<float>").withColumn("id", F.lit("mine"))
    assert [tuple(r) for r in H.scaled(df, "key", "a.b", "kind", 256).orderBy("id").collect()] == [(1, 1, [128, -1]), (7, 1, []), (8, 2, [0])]


def test_the_annulus_prunes():
    """Of well clustered rows an anchor's annulus reaches few: most scores aren't computed."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-2000, 2000, (32, 16))
    x = (centres[rng.integers(32, size=4096)] + rng.integers(-20, 21, (4096, 16))).astype(np.float64)
    space = H.Space(16, int((x * x).sum(1).max()))
    order, *tree = H.build_tree(space, x, 32)
    x, ids, labels = x[order], np.arange(4096), np.zeros(4096, np.int64)
    q = x[:50]
    asks = H.Asks(np.full(50, -1), np.zeros(50, np.int64), q, (q * q).sum(1), *[np.full((50, 1), v) for v in (H._NONE, -H._NONE, H._NONE)])
    found, scores, computed = H.search(space, tuple(tree), ids, labels, x, asks, 5, True)
    whole = q @ x.T
    want = np.lexsort((np.broadcast_to(ids, whole.shape), -whole), axis=-1)[:, :5]
    assert (found[:, 0] == want).all() and (scores[:, 0] == np.take_along_axis(whole, want, 1)).all()
    assert computed < whole.size / 3
