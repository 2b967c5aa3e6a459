from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline as C
from codexa.llm import overlap
from tests.llm.conftest import SCHEMA, SF, prose


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """The smallest id of each row's component, by the overlap of all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return sorted(str((x, least.get(find(i)))) for i, (x, _) in enumerate(rows))


def near_the_limit():
    """Texts with 0 to 9 words changed: overlaps from 0.5 to 1."""
    rng, rows = random.Random(8), []
    for k in range(30):
        base = prose(3000 + k, 130).split()
        rows.append(" ".join(base))
        for n in range(10):
            changed = [*base]
            for i in rng.sample(range(130), n):
                changed[i] = f"new{rng.random()}"
            rows.append(" ".join(changed))
        rows.append(" ".join(rng.sample(base, 130)))  # the same words, hardly a shingle
    rng.shuffle(rows)
    return list(enumerate(rows))


def shown(df):
    return sorted(str((r.id, r.component_id)) for r in df.collect())


def test_links_are_those_of_brute_force(spark):
    rows = near_the_limit()
    assert shown(overlap.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), C.NEAR_SEEDS)) == plain_groups(rows)


def test_stage_keeps_one_of_each_group(spark):
    rows = near_the_limit()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    want = {g for g in plain_groups(rows) if eval(g)[0] == eval(g)[1]}
    assert {str((r.doc_id, r.doc_id)) for r in C.one_of_each_group(spark, docs, "").collect()} == want


def test_odd_tables(odd, odd_rows, empty, clashing):
    want = plain_groups([r[:2] for r in odd_rows])
    for df in (odd, clashing):
        assert shown(overlap.near_duplicates(df, C.NEAR_SEEDS)) == want
    assert overlap.near_duplicates(empty, C.NEAR_SEEDS).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert shown(overlap.near_duplicates(docs, C.NEAR_SEEDS)) == plain_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_prefixes_are_not_broadcast(spark):
    held = spark.createDataFrame([(1, 0, 1, 9, 1, 2), (1, 0, 2, 9, 2, 2)], "shingle long, place long, key long, n long, comp long, top long")
    pairs = overlap._meeting(held, overlap.LEAST)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
