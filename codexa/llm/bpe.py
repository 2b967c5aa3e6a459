"""BPE encoding and decoding by speculation: a greedy longest match proposes the tokens of a word, a vectorised test
checks that each adjacent pair of tokens is one that merging would leave apart, and only words with a failing pair are
merged exactly.

The test rests on a known property of BPE (Berglund and van der Merwe, "Formalizing BPE tokenization", 2023): a
sequence of tokens, each of which is the encoding of its own string, is the encoding of the whole if and only if each
adjacent pair is the encoding of its concatenation. For one pair, time is run backwards from the two tokens: whichever
of the two symbols at the border was formed last is split, and the pair is refused if the two symbols that met there
would have merged before one of them became part of the token it is in.

Texts are cut at ASCII white space, where no word, special token or composed character goes across. Equal chunks are
looked up; new ones of Latin letters are split into words by a pattern for that range of characters, all others by the
tokenizer file's own normaliser and splitter. Equal words are encoded once for each Python worker. Both caches are bounded.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codexa.llm.common import int_lists, set_aside, slices, trim, with_column

END = "</w>"
#: Words, and chunks of texts, that a worker remembers; beyond that it starts anew.
CACHE_WORDS, CACHE_CHUNKS = 300_000, 400_000
#: Words of up to so many symbols are merged exactly in tables of that width; longer ones each alone.
SIDE_BY_SIDE = (6, 9, 13, 20)
#: Pairs of tokens that a worker remembers.
PAIRS = 300_000
#: In texts up to U+024F, NFC changes nothing, and letters, numbers and white space are these.
_OUTSIDE = re.compile("[^\x00-\u024f]").search
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|\n|[^ \t-\r\x85\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+").findall
#: Marks words that are already in the vocabulary's byte alphabet.
_CODED = "\0"
#: A word's end where words are matched, a chunk's among words, and what marks special tokens there; not in the byte alphabet.
_STOP = "\n"
_NEVER = np.int64(1 << 40)


class _Known:
    """Tokens of strings, in one array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}  # first place in _flat << 32 | tokens
        self._flat = np.empty(0, np.uint32)
        self._used = 0

    def __len__(self) -> int:
        return len(self.place)

    def places(self, strings: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
        """What `place` has for each of these distinct strings; learn() has to add those that it doesn't have."""
        found = [*map(self.place.get, strings)]
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            own = [strings[i] for i in new]
            learn(own)
            for i, x in zip(new, map(self.place.__getitem__, own), strict=True):
                found[i] = x
        return np.array(found, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        more = len(ids)
        if self._used + more > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty(max(len(self._flat), more), np.uint32)])
        self._flat[self._used : self._used + more] = ids
        first = self._used + np.cumsum(sizes) - sizes
        self.place.update(zip(strings, (first << 32 | sizes).tolist(), strict=True))
        self._used += more

    def tokens(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of strings after each other, and where each string's begin, and the last's end."""
        start, n = places >> 32, places & 0xFFFFFFFF
        cuts = np.append(0, np.cumsum(n))
        return self._flat[np.repeat(start - cuts[:-1], n) + np.arange(cuts[-1])], cuts


class SpeculativeBPE:
    """An encoder and decoder for a tokenizer file with word ends: NFC, white space to one blank, lower case."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lib = Tokenizer.from_file(path)
        self.normalize, self.pretokenize = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("a special token with white space would be cut in two")
        special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split_special = special.split if special else None
        marked = all("<|" in s for s in self.special)  # then a quick look tells
        self._has_special = (lambda t: "<|" in t) if marked and special else special.search if special else lambda t: False
        self._lib_decode = lib.decode if spec.get("decoder") else None
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings = np.empty(size, object)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.formed = np.full(size, -1, np.int64)  # the rank of the merge that makes a token; -1: none
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.ranks[i, j] = rank, k
            if self.formed[k] < 0:
                self.formed[k], self.left[k], self.right[k] = rank, i, j
        self._made = np.array([k for _, k in sorted(self.ranks.values())], np.int64)
        keys = np.array([a << 20 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        #: Only tokens that are the encoding of their own string are proposed.
        self._propose = {s: i for s, i in self.vocab.items() if self.formed[i] < 0 or self.merge(self._symbols(s)) == [i]}
        self._lengths = np.zeros(size, np.int64)  # with one for a word's end
        self._longest = ahocorasick.Automaton()
        for s, i in self._propose.items():
            match = s.removesuffix(END) + (_STOP if s.endswith(END) else "")
            self._longest.add_word(match, i)
            self._lengths[i] = len(match)
        self._longest.make_automaton()
        self._pairs: dict[int, bool] = {}
        self.exact_words = self.words = 0
        self._chunks, self._words = _Known(), _Known()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self._letters = np.arange(256, dtype="<u2")
        self._letters[[b for b in others if chr(b) != _STOP]] = [256 + i for i, b in enumerate(others) if chr(b) != _STOP]
        alphabet = [*map(chr, plain), *(chr(256 + i) for i in range(len(others)))]
        self._symbol_of, self._last_symbol_of = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in alphabet:
            self._symbol_of[ord(c)], self._last_symbol_of[ord(c)] = self.vocab.get(c, 0), self.vocab.get(c + END, 0)

    def release(self) -> None:
        """Gives the memory of remembered chunks, words and pairs back: a worker lives on after its task."""
        self._chunks, self._words, self._pairs = _Known(), _Known(), {}
        trim()

    def _symbols(self, token: str) -> list[int]:
        body = token.removesuffix(END)
        parts = [*body]
        if body != token:
            parts[-1] += END
        return [self.vocab[c] for c in parts]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging of one word's symbols: always the lowest rank, leftmost first."""
        n = len(ids)
        after, before, ids = [*range(1, n), -1], [*range(-1, n - 1)], [*ids]
        todo = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.ranks.get((ids[i], ids[i + 1])))]
        todo = [(r, i, k, a, b) for r, k, i, a, b in todo]
        heapq.heapify(todo)
        while todo:
            _, i, k, a, b = heapq.heappop(todo)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(todo, (m[0], x, m[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[list[int]]) -> list[list[int]]:
        """merge() of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, sizes = self._merged(np.array([t for w in words for t in w], np.int64), sizes)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if words else []

    def _merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of each word of `sizes` symbols: the tokens of all, and how many each has. Words of about one length go side by side."""
        first, out_sizes = np.cumsum(sizes) - sizes, sizes.copy()
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        low = 1
        for most in SIDE_BY_SIDE:
            own = np.flatnonzero((sizes > low) & (sizes <= most))
            low = most
            if len(own):
                place = np.arange(most + 1)
                table = np.where(place < sizes[own, None], symbols[np.minimum(first[own, None] + place, len(symbols) - 1)], -1)
                rows += self._steps(own, table)
        rows += [(np.array([i]), np.array([self.merge(symbols[first[i] : first[i] + sizes[i]].tolist())])) for i in np.flatnonzero(sizes > low).tolist()]
        for which, table in rows:
            out_sizes[which] = (table >= 0).sum(1)
        at = np.cumsum(out_sizes) - out_sizes
        out = np.empty(int(out_sizes.sum()), np.int64)
        alone = np.flatnonzero(sizes == 1)
        out[at[alone]] = symbols[first[alone]]
        for which, table in rows:
            held = table >= 0
            out[(at[which, None] + np.arange(table.shape[1]))[held]] = table[held]
        return out, out_sizes

    def _steps(self, todo: np.ndarray, table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merging of the words `todo`, a row each (-1 behind the last symbol), one merge a step: (words, rows) as they end."""
        out, most = [], table.shape[1] - 1
        ranks = self._rank(table[:, :-1], table[:, 1:])
        places = np.arange(most + 1)
        while len(todo):
            best = ranks.argmin(1)
            lines = np.arange(len(todo))
            rank = ranks[lines, best]
            done = rank == _NEVER
            if done.any():
                out.append((todo[done], table[done]))
                todo, table, ranks, best, rank = (v[~done] for v in (todo, table, ranks, best, rank))
                lines = np.arange(len(todo))
                if not len(todo):
                    break
            table[lines, best] = self._made[rank]
            take = np.minimum(places + (places > best[:, None]), most)
            table = np.take_along_axis(table, take, 1)
            table[:, most] = -1
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], most - 1), 1)
            ranks[:, most - 1] = _NEVER
            before = np.maximum(best - 1, 0)
            ranks[lines, best] = self._rank(table[lines, best], table[lines, best + 1])
            ranks[lines, before] = self._rank(table[lines, before], table[lines, before + 1])
        return out

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging x and y; _NEVER where they don't merge."""
        key = np.where((x < 0) | (y < 0), -1, x << 20 | y)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def _proposed(self, joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches: tokens of all words, how many each word has, and the words that they don't cover."""
        borders = np.cumsum(lengths)
        found = np.fromiter(chain.from_iterable(self._longest.iter_long(joined)), np.int64).reshape(-1, 2)
        ends, tokens = found[:, 0], found[:, 1]
        of = np.searchsorted(borders, ends, side="right")
        covered = np.bincount(of, self._lengths[tokens], len(lengths)).astype(np.int64)
        return tokens, np.bincount(of, minlength=len(lengths)), np.flatnonzero(covered != lengths)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of tokens as it is, for all pairs at once."""
        good, todo = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        over_x, over_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(todo):
            rank = self._rank(x, y)
            bad = (rank < over_x) & (rank <= over_y)
            good[todo[bad]] = False
            fx, fy = self.formed[x], self.formed[y]
            on = ~bad & ((fx >= 0) | (fy >= 0))
            todo, x, y, over_x, over_y, fx, fy = (v[on] for v in (todo, x, y, over_x, over_y, fx, fy))
            later = fx > fy  # of two alike the right one was made last
            over_x, over_y = np.where(later, fx, over_x), np.where(later, over_y, fy)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word (in the byte alphabet of the vocabulary)."""
        flat, sizes = self._encoded(_STOP.join([*words, ""]))
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if words else []

    def _encoded(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words of a string in which _STOP ends each, and how many each has."""
        if not joined:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.flatnonzero(points == ord(_STOP))
        lengths = np.diff(stops, prepend=-1)
        flat, sizes, uncovered = self._proposed(joined, lengths)
        refused = np.zeros(len(lengths), bool)
        refused[uncovered] = True
        of = np.repeat(np.arange(len(lengths)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        inner = inner[~refused[of[inner]]]
        codes, back = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        refused[of[inner[~self._apart(codes)[back]]]] = True
        symbols = self._symbol_of[points]
        symbols[stops - 1] = self._last_symbol_of[points[stops - 1]]
        merged, exact_sizes = self._merged(symbols[np.repeat(refused, lengths) & (points != ord(_STOP))], lengths[refused] - 1)
        self.exact_words += len(exact_sizes)
        self.words += len(lengths)
        sizes = sizes.copy()
        sizes[refused] = exact_sizes
        out = np.empty(int(sizes.sum()), np.int64)
        exact = np.repeat(refused, sizes)
        out[~exact] = flat[~refused[of]]
        out[exact] = merged
        return out, sizes

    def _apart(self, codes: np.ndarray) -> np.ndarray:
        """compatible() of pairs of tokens (first << 20 | second), which a worker remembers."""
        known = [*map(self._pairs.get, codes.tolist())]
        new = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        if len(new):
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            for i, ok in zip(new.tolist(), self.compatible(codes[new] >> 20, codes[new] & 0xFFFFF).tolist(), strict=True):
                known[i] = self._pairs[int(codes[i])] = ok
        return np.array(known, bool)

    def _coded(self, words: list[str]) -> str:
        """All words in the vocabulary's byte alphabet, each ended by _STOP."""
        joined = _STOP.join([*words, ""])
        if _CODED in joined and any(marked := [w[0] == _CODED and len(w) > 1 for w in words]):
            return "".join(w[1:] + _STOP if m else self._coded([w]) for w, m in zip(words, marked, strict=True))
        return self._letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def _cut(self, chunk: str) -> list[str]:
        """A chunk's words; those not of Latin letters are coded and marked, special tokens have a _STOP before them."""
        out: list[str] = []
        for piece in self.split_special(chunk) if self._has_special(chunk) else [chunk]:
            if piece in self.special:
                out.append(_STOP + piece)
            elif _OUTSIDE(piece) is None and _CODED not in piece:
                out += _LATIN_WORDS(piece.lower())
            else:
                out += [_CODED + w for w, _ in self.pretokenize(self.normalize(piece))]
        return out

    def _words_of(self, chunks: list[str]) -> list[str]:
        """The words of all chunks, with a _STOP after those of each."""
        joined = _STOP.join([*chunks, ""])
        if _OUTSIDE(joined) is None and _CODED not in joined and not self._has_special(joined):
            return _LATIN_WORDS(joined.lower())
        latin = [_OUTSIDE(c) is None and _CODED not in c and not self._has_special(c) for c in chunks]
        out = _LATIN_WORDS(_STOP.join([*(c if plain else "" for c, plain in zip(chunks, latin, strict=True)), ""]).lower())
        if all(latin):
            return out
        others = iter([i for i, plain in enumerate(latin) if not plain])
        ends, at, more = (i for i, w in enumerate(out) if w == _STOP), 0, []
        odd = next(others)
        for i, end in enumerate(ends):
            if i == odd:
                more += out[at:end] + self._cut(chunks[i])
                at, odd = end, next(others, -1)
        return more + out[at:]

    def _learn_words(self, words: list[str]) -> None:
        """Remembers the tokens of words not met before."""
        special = {w for w in words if w[0] == _STOP}
        for w in special:
            self._words.add([w], np.array([self.special[w[1:]]] if w[1:] else [], np.int64), np.array([len(w) > 1], np.int64))
        if words := [w for w in words if w not in special]:
            self._words.add(words, *self._encoded(self._coded(words)))

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Remembers the tokens of chunks not met before."""
        if len(self._words) > CACHE_WORDS:
            self._words = _Known()
        coded = pa.array(self._words_of(chunks), pa.string()).dictionary_encode()
        distinct, which = _strings(coded.dictionary), coded.indices.to_numpy()
        flat, cuts = self._words.tokens(self._words.places(distinct, self._learn_words)[which])
        ends = cuts[1:][which == distinct.index(_STOP)]
        self._chunks.add(chunks, flat, np.diff(ends, prepend=0))

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Token ids of each text; null counts as empty."""
        if len(self._chunks) > CACHE_CHUNKS:
            self._chunks = _Known()
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""))
        coded = split.flatten().dictionary_encode()
        flat, cuts = self._chunks.tokens(self._chunks.places(_strings(coded.dictionary), self._learn_chunks)[coded.indices.to_numpy()])
        borders = cuts[np.append(0, np.cumsum(pa.compute.list_value_length(split).to_numpy()))].tolist()
        return [flat[i:j] for i, j in zip(borders, borders[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes: where the file names no decoder, the tokens' strings, joined by blanks."""
        if self._lib_decode:
            return self._lib_decode([int(i) for i in ids], skip_special_tokens=False)
        return " ".join(self.strings[ids].tolist())


def _strings(array: pa.StringArray) -> list[str]:
    """As to_pylist(), which is slower."""
    return array.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> SpeculativeBPE:
    """One encoder for each Python worker and file."""
    return SpeculativeBPE(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text (array of int) in column `ids`, which replaces one of that name.

    A null text counts as empty and has no tokens; strings of special tokens in a text give those tokens. With
    `decoded`, the ids are decoded again into a column of that name in the same pass. Rows keep their other columns,
    whatever these are called; repeated rows stay repeated, an empty table stays empty.
    """
    keep, back = set_aside(docs.drop(*[c for c in (ids, decoded) if c in docs.columns]), text)
    coded = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    schema = T.StructType([*coded.fields, T.StructField(decoded, T.StringType(), False)]) if decoded else coded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in slices(batches, text, 4 << 20):
            got = bpe.encode_batch(b.column(text))
            out = with_column(b, ids, int_lists(got), coded)
            yield with_column(out, decoded, pa.array(map(bpe.decode, got), pa.string()), schema) if decoded else out
        bpe.release()

    return back(keep.mapInArrow(run, schema), ids, *([decoded] if decoded else []))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null ids give an empty text."""
    keep, back = set_aside(df.drop(decoded) if decoded in df.columns else df, ids)
    schema = T.StructType([*keep.schema.fields, T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, min(500, b.num_rows - at))
                texts = [bpe.decode(np.array(x or [], np.int64)) for x in part.column(ids).to_pylist()]
                yield with_column(part, decoded, pa.array(texts, pa.string()), schema)

    return back(keep.mapInArrow(run, schema), decoded)
