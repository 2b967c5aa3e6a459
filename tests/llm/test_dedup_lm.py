from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codexa.llm import common, lm_mix, simhash, substring
from codexa.llm.common import fold
from tests.llm.conftest import SF, prose

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups_of(fps):
    """The first index that each can reach."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(odd_rows):
    for r in odd_rows:
        assert simhash.fingerprint(r[1]) == signed(plain_fingerprint(r[1]))
    assert simhash.fingerprint("É A") == signed(plain_fingerprint("É a")) and simhash.fingerprint(None) == 0


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_probes_are_not_broadcast(spark):
    links = simhash.far_links(spark.createDataFrame([(7, 7), (7 << 40, 7 << 40)], "fp long, comp long"))
    assert "SortMergeJoin" in plan_of(links) and "Broadcast" not in plan_of(links)


@pytest.mark.parametrize("heavy", [simhash.HEAVY, 2, 0])
def test_components_of_planted_fingerprints(spark, heavy):
    rng = random.Random(11)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        fps += [base]
        for _ in range(rng.randint(0, 12)):
            fps.append(rng.choice(fps[-8:]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    half = rng.getrandbits(32)  # many that share a half, some of them 3 bits apart
    fps += [half | (rng.getrandbits(32) << 32) for _ in range(20)]
    fps += [fps[-1] ^ 0b111 << 40, fps[-2] ^ 1 << 3 ^ 1 << 50 ^ 1 << 63, fps[-3] ^ 0b111, 0, 1, (1 << 64) - 1]
    rng.shuffle(fps)
    each = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    near = simhash.components(simhash.near_links(each.select("fp", F.col("fp").alias("comp"))))
    members = each.join(near, each.fp == near.node, "left").select("fp", F.coalesce("comp", "fp").alias("comp"))
    far = simhash.components(simhash.far_links(members, heavy))
    got = members.join(far, members.comp == far.node, "left").select("fp", F.coalesce(far.comp, members.comp).alias("c")).collect()
    want = groups_of(fps)
    by = {signed(f): g for f, g in zip(fps, want, strict=True)}
    pairs = {(r.c, by[r.fp]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(want))


def test_long_chain_of_links(spark):
    links = spark.range(0, 700).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash.components(links.unionByName(spark.createDataFrame([(900, 901)], "u long, v long")))
    assert {(r.node, r.comp) for r in got.where("node <> comp").collect()} >= {(700, 0), (350, 0), (901, 900)}
    assert {r.comp for r in got.collect()} == {0, 900}
    assert simhash.components(links.limit(0)).count() == 0


def test_near_duplicate_tables(odd, odd_rows, empty, clashing):
    fps = [plain_fingerprint(r[1]) for r in odd_rows]
    groups = groups_of(fps)
    want = []
    for r, f, g in zip(odd_rows, fps, groups, strict=True):
        ids = [s[0] for s, h in zip(odd_rows, groups, strict=True) if h == g and s[0] is not None]
        want.append((r[0], signed(f), min(ids) if ids else None))
    for df in (odd, clashing):
        assert sorted(map(str, (tuple(r) for r in simhash.near_duplicates(df).select("id", "fp", "component_id").collect()))) == sorted(map(str, want))
    assert simhash.near_duplicates(empty).count() == 0


def test_several_seeds(spark, odd, odd_rows):
    """Rows are linked if the fingerprints of any seed are; close texts are found, others left alone."""
    rng = random.Random(4)
    rows = []
    for k in range(25):
        base = prose(1000 + k, 150).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            changed = [*base]
            for i in rng.sample(range(150), 3):
                changed[i] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(changed)))
    seeds, texts = (42, 43, 44), spark.createDataFrame(rows, "doc_id long, text string")
    for table, given in ((texts, rows), (odd, [r[:2] for r in odd_rows])):
        parent = list(range(len(given)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        fps = [[simhash.fingerprint(t, 1, s, True) & (1 << 64) - 1 for s in seeds] for _, t in given]
        for i in range(len(given)):
            for j in range(i):
                if any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True)):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        least = {}
        for i, (x, _) in enumerate(given):
            if x is not None:
                least[find(i)] = min(x, least.get(find(i), x))
        want = sorted(str((x, least.get(find(i)))) for i, (x, _) in enumerate(given))
        for heavy in (simhash.HEAVY, 1):
            got = simhash.near_duplicates(table, words=1, seeds=seeds, distinct=True, heavy=heavy).collect()
            assert sorted(str((r.id, r.component_id)) for r in got) == want
    found = {r.component_id for r in simhash.near_duplicates(texts, words=1, seeds=seeds, distinct=True).collect()}
    assert 25 <= len(found) <= 50 and len({x // 4 for x in found}) == 25


def plain_cut(rows, window):
    first, out = {}, []
    key = lambda r: math.inf if r[0] is None else r[0]
    words = [(r[1] or "").encode().split() for r in rows]
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, math.inf), key(r))
    for r, w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key(r) for k in range(i, i + window)}
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [3, 13])
def test_substrings(spark, odd, odd_rows, empty, clashing, window):
    for df in (odd, clashing):
        got = substring.dedup_substrings(df, window=window).collect()
        assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got))) == sorted(map(str, plain_cut(odd_rows, window)))
        for r in got:
            spans = [(s.start, s.stop) for s in r.removed]
            assert sum(b - a for a, b in spans) == r.n_removed and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert substring.dedup_substrings(empty).count() == 0
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(plain_cut(rows, window))


@needs_tables
def test_substrings_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = substring.dedup_substrings(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(plain_cut(rows, 13))


def plain_base(rows, train):
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    counts = Counter(w for w, ok in zip(tokens, train, strict=True) if ok for w in w)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for (i, _), w in zip(rows, tokens, strict=True)]


def test_language_model_tables(odd, odd_rows, empty, clashing):
    rows = [r[:2] for r in odd_rows]
    learns = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 != 0 for i, _ in rows]
    for df in (odd, clashing):
        got = lm_mix.score(df, fold("doc_id", 10) != 0).collect()
        assert sorted(map(str, ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got))) == sorted(map(str, plain_base(rows, learns)))
        assert all(r.score < 0 for r in got)
    blank = lm_mix.score(odd, F.lit(False)).where("doc_id = 9").first()
    assert blank.train_tokens == 0 and blank.score == pytest.approx(-40 * math.log10(2), rel=1e-3)  # five bytes at 1/2 a bit
    assert lm_mix.score(empty, F.lit(True)).count() == 0


def averaged(arrays, evidence):
    """Place by place, over shards, weighed by evidence and one more."""
    out = np.zeros(arrays[0].shape)
    for place in np.ndindex(out.shape):
        w = [e[place] + 1.0 for e in evidence]
        out[place] = sum(x * a[place] for x, a in zip(w, arrays, strict=True)) / sum(w)
    return out


def plain_scores(rows, train, share):
    """Scores by loops over all tokens: counts in dictionaries, gates moved and asked token by token within each step.

    rows: id, text, key, shard.
    """
    texts = [lm_mix.tokens(r[1]) for r in rows]
    count, pair = Counter(), Counter()
    for text, ok in zip(texts, train, strict=True):
        if ok:
            count.update(text)
            pair.update(zip([None, *text], text, strict=False))
    n = sum(count.values())
    words = sorted(count)
    slot_bits = min(lm_mix.MOST_SLOT_BITS, max(lm_mix.LEAST_SLOT_BITS, (4 * len(words)).bit_length()))
    spelling = lm_mix.Mixer.fresh(lm_mix.count_bits(words, slot_bits))
    shards = max(1, -(-int(len(words) * share) // lm_mix.SHARD_WORDS))
    parts = {}
    for w in words:
        if (h := xxhash.xxh64_intdigest(w, 1)) < int((1 << 64) * share):
            parts.setdefault(h % shards, []).append(w)
    learned = [(m := lm_mix.Mixer.fresh(spelling.counts), m.learn(part)) for part in parts.values()]
    if learned:
        spelling.weights = averaged([m.weights for m, _ in learned], [np.tile(met[:, None], (1, len(lm_mix.ORDERS))) for _, (met, _) in learned])
        spelling.cells = averaged([m.cells for m, _ in learned], [cells.reshape(lm_mix.GATES, -1) for _, (_, cells) in learned])
    log = lambda x: math.log2(x) if x > 0 else -math.inf
    slot = lambda a: (int(lm_mix.START if a is None else xxhash.xxh64_intdigest(a)) * int(lm_mix._MIX[4]) % (1 << 64)) >> (64 - 10)

    def steps(text, own):
        out, wins = [], []
        for a, w in zip([None, *text], text, strict=False):
            former = count[b"" if a is None else a] - own
            c, both = count[w] - own, pair[a, w] - own
            bits = spelling.cost([w], own=bool(own and not c))[0] if own and not c else float(np.float32(spelling.cost([w])[0]))
            experts = [-bits, log(c / max(n - own, 1)), log(both / max(former, 1))]
            level = min(lm_mix.LEVELS - 1, int(math.log2(former + 1)))
            out.append((experts, level * lm_mix.HISTORY + sum(wins[-(lm_mix.HISTORY - 1) :]), slot(a)))
            wins.append(experts[2] > experts[1])
        return out

    fits = []
    for shard in {r[3] for r in rows}:
        own = lm_mix.Gates.fresh()
        seen = [x for i in sorted(range(len(rows)), key=lambda i: rows[i][2]) if train[i] and rows[i][3] == shard for x in steps(texts[i], 1)]
        if n > 1 and seen:
            own.learn(np.array([x[0] for x in seen]), np.array([x[1] for x in seen]), np.array([x[2] for x in seen]))
        met = Counter(x[1] for x in seen), Counter(x[2] for x in seen)
        fits.append((own, [np.array([[m[i]] * 3 for i in range(len(table))]) for m, table in zip(met, (own.by_level, own.by_former), strict=True)]))
    gates = lm_mix.Gates(averaged([g.by_level for g, _ in fits], [m[0] for _, m in fits]), averaged([g.by_former for g, _ in fits], [m[1] for _, m in fits]))
    out = []
    for (i, *_), text in zip(rows, texts, strict=True):
        total = 0.0
        for experts, gate, former in steps(text, 0):
            odds = np.exp(gates.by_level[gate] + gates.by_former[former])
            total += math.log10(sum(o * 2.0**e for o, e in zip(odds / odds.sum(), experts, strict=True)))
        out.append((i, round(total, 3)))
    return out


@pytest.mark.parametrize(("share", "words", "size"), [(1.0, 1 << 16, 8 << 20), (0.5, 40, 1500)])
def test_language_model_scores(spark, monkeypatch, share, words, size):
    monkeypatch.setattr(lm_mix, "SHARD_WORDS", words)
    monkeypatch.setattr(lm_mix, "SHARD_BYTES", size)
    rng, rows = random.Random(5), []
    for k in range(60):
        words = prose(k % 25, 40).split()
        if k >= 25:
            words[rng.randrange(40)] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "One"), (62, "One"), (63, " ".join(rng.sample(prose(3, 40).split(), 40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = max(1, -(-sum(len(t or "") for _, t in rows) // size))
    shard = F.pmod(F.xxhash64("k", F.lit("shard")), F.lit(shards)).alias("s")
    keyed = [tuple(r) for r in docs.withColumn("k", common.row_key()).select("*", shard).collect()]
    assert len({r[3] for r in keyed}) == shards and (shards > 1) == (size < 1 << 20)
    train = [r[0] % 5 != 0 for r in keyed]
    want = sorted(plain_scores(keyed, train, share))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found = lm_mix.score(docs, F.col("doc_id") % 5 != 0, spelling_share=share).collect()
            assert {r.doc_id: r.score for r in found} == pytest.approx(dict(want), abs=2e-3)
            for r in found:
                assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / sum(len(w) + 1 for w in lm_mix.tokens(r.text)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dict(want)[3] > dict(want)[63] + 10  # the order of words counts


def test_mixer_of_spelling_learns_from_all_words(spark):
    words = sorted({w.encode() for w in prose(11, 3000).split()})
    vocabulary = spark.createDataFrame([(b" ".join(words[k::3]),) for k in range(3)], "words binary")
    mixer = lm_mix._spelling(vocabulary, len(words), lm_mix.SPELLING_SHARE, 14).value
    want = lm_mix.Mixer.fresh(lm_mix.count_bits(words, mixer.slot_bits))
    want.learn(words)
    assert np.allclose(mixer.weights, want.weights) and np.allclose(mixer.cells, want.cells)
    assert np.allclose(mixer.cost(words), want.cost(words)) and np.allclose(mixer.cost(words, own=True), want.cost(words, own=True))


def test_language_model_with_rows_repeated_often(spark):
    """Rows that are the same are dealt to many buckets; each counts, and all have one score."""
    text = prose(9, 30)
    docs = spark.range(0, 900).select(F.when(F.col("id") < 400, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 400, text).otherwise(F.concat(F.lit("one "), F.col("id") % 50)).alias("text"))
    salted, size = lm_mix._salted(docs.withColumn("_key", common.row_key()), "text")
    per = {r.n: r["count"] for r in salted.groupBy(F.col("_salt").isNull().alias("n")).count().collect()}
    assert per == {False: 400, True: 500} and salted.where("_salt is not null").agg(F.countDistinct("_salt")).first()[0] == 400
    assert size == docs.agg(F.sum(F.octet_length("text"))).first()[0]
    got = lm_mix.score(docs, F.lit(True)).where("doc_id is null").collect()
    assert len(got) == 400 and len({round(r.score, 9) for r in got}) == 1
    assert got[0].train_tokens == 400 * 31 + 500 * 3 and got[0].n_known == got[0].n_tokens == 31


def test_language_model_learns():
    texts = [prose(k, 200) for k in range(60)]
    counts = Counter(w for t in texts[:50] for w in lm_mix.tokens(t))
    words = [*counts]
    model = lm_mix.Mixer.fresh(lm_mix.count_bits(words, 16))
    held = Counter(w for t in texts[50:] for w in lm_mix.tokens(t))
    bits = lambda: sum(c * held[w] for w, c in zip(held, model.cost([*held]), strict=True))
    before = bits()
    model.learn(words)
    assert bits() < before and bits() < 3 * sum((len(w) + 1) * c for w, c in held.items())


def test_word_probabilities_do_not_exceed_one():
    words = [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)] + [bytes([a]) for a in range(97, 123)] + [b""]
    model = lm_mix.Mixer.fresh(lm_mix.count_bits(words, 16))
    model.learn(words)
    assert 0.3 < (2.0 ** -model.cost(words)).sum() <= 1 + 1e-6


def test_lookup_with_hot_keys(spark, monkeypatch):
    left = spark.range(0, 3000).select((F.when(F.col("id") < 1000, 7).otherwise(F.col("id"))).alias("k"), "id")
    right = spark.createDataFrame([(7, "hot"), (1500, "cold")], "k long, v string")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    got = common.hot_safe_join(left, right, "k", counts)
    assert {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {"hot": 1000, "cold": 1, None: 1999}
