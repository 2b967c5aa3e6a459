from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexa.llm import bpe, packing
from codexa.llm.queries import tokenizer_path
from tests.llm.conftest import prose, shown


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.SpeculativeBPE(tokenizer_path())


def same(coder, library, texts):
    for t, got in zip(texts, coder.encode_batch(texts), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got.tolist() == want, t
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(coder, library, odd_rows):
    same(coder, library, [r[1] for r in odd_rows] + ["it's <|startoftext|>Foo’s", "ΑΣ İstanbul ǅ ẞ ﬁ", "́abc", "'sab don'T we'LLx '''re", "é ẛ̣", "<|endoftext|><|endoftext|>", "a​b ᠎ 1²½Ⅷ", "हिन्दी ไทย 👩‍👩‍👧", "a" * 3000, "\x1fa \x7f"])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(coder, library, text):
    same(coder, library, [text])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdeinorst'.!1", max_size=30), max_size=8))
def test_words(coder, library, texts):
    same(coder, library, texts)


def test_compatible_is_what_merging_says(coder):
    rng = random.Random(5)
    every = [t for s, t in coder.vocab.items() if not s.endswith(bpe.END)]
    pairs = [(rng.choice(every), rng.choice(every)) for _ in range(3000)]
    got = coder.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), ok in zip(pairs, got.tolist(), strict=True):
        symbols = [coder.vocab[c] for c in coder.strings[a] + coder.strings[b]]
        assert (coder.merge(symbols) == [a, b]) == ok


def test_side_by_side_merging(coder):
    words = [coder._symbols(prose(k, 1).replace(".", "") + bpe.END) for k in range(300)]
    assert coder.merge_many(words) == [coder.merge(w) for w in words]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    small = bpe.SpeculativeBPE(tokenizer_path())
    for k in range(5):
        same(small, library, [prose(k, 40)])


def test_equal_chunks_are_split_once(library, monkeypatch):
    split, seen = bpe._LATIN_WORDS, []
    monkeypatch.setattr(bpe, "_LATIN_WORDS", lambda text: seen.append(len(text)) or split(text))
    own = bpe.SpeculativeBPE(tokenizer_path())
    texts = ["Don't stop, it's 1²½ naïve\x85über a\xa0b.\n\t", "日本 don't stop, <|endoftext|>x it's\0 \x1c"] * 200
    same(own, library, texts)
    same(own, library, texts[::-1])
    assert sum(seen) < 200


def test_small_chunk_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    small = bpe.SpeculativeBPE(tokenizer_path())
    for k in range(5):
        same(small, library, [prose(k, 40) + " é日 <|endoftext|>", None, ""])


def test_encode_tables(spark, odd, empty, clashing, library):
    rows = bpe.encode(odd, tokenizer_path(), decoded="decoded").collect()
    assert len(rows) == 15
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd, tokenizer_path()), tokenizer_path())
    assert shown(again, "doc_id", "decoded") == sorted(f"Row(doc_id={r.doc_id}, decoded={r.decoded!r})" for r in rows)
    assert bpe.encode(empty, tokenizer_path()).count() == 0
    kept = bpe.encode(clashing, tokenizer_path(), decoded="decoded")
    assert {r.words for r in kept.collect()} == {"mine"} and shown(kept, "ids") == shown(again, "ids")


def check_bins(lengths, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in bins)


def fewest(lengths, capacity):
    """By trying all."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i]:
                place(i + 1, [*free[:k], free[k] - lengths[i], *free[k + 1 :]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_as_good_as_trying_all(lengths):
    bins = packing.complete_bins(lengths, 20)
    check_bins(lengths, bins, 20)
    assert len(bins) == fewest(sorted(lengths, reverse=True), 20)


def test_bin_completion_beats_best_fit():
    rng = random.Random(3)
    better = 0
    for _ in range(200):
        lengths = [rng.randint(15, 60) for _ in range(30)]
        bins = packing.complete_bins(lengths, 100)
        check_bins(lengths, bins, 100)
        assert packing.lower_bound(lengths, 100) <= len(bins) <= len(packing.best_fit(lengths, 100))
        better += len(bins) < len(packing.best_fit(lengths, 100))
    assert better


def test_dominance():
    assert packing.dominated((4, 3), (7,)) and packing.dominated((4,), (5,)) and not packing.dominated((6,), (5, 5)) and packing.dominated((), (1,))
    out = packing.fillings(np.array([2, 3, 5]), np.array([1, 1, 1]), 5)
    assert out[0] == (5,) and (3, 2) not in out


def check_packed(rows, texts, library, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        want += [(i, k, at, np.array(ids[at : at + capacity], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, bytes(r.ids))) for r in rows)
    return len(by)


@pytest.mark.parametrize("chunk", [packing.CHUNK_TOKENS, 900])
def test_pack_tables(odd, odd_rows, empty, clashing, library, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK_TOKENS", chunk)
    for df in (odd, clashing):
        n = check_packed(packing.pack_documents(df, tokenizer_path(), 512).collect(), [r[:2] for r in odd_rows], library, 512)
    total = sum(len(library.encode(r[1] or "").ids) + 1 for r in odd_rows)
    assert n <= -(-total // 512) + 3
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
