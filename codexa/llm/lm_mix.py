"""Language-model scoring by online logistic context mixing.

A text is its words, lower-cased in A to Z, each ended by a blank, and one empty word as its end. Three experts give each
word a probability, and logistic gates weigh them anew at each word:

0. The word's spelling, bit by bit: several predictors look up counts of zeros and ones under a hash of their context (the
   last 1 to 4 bytes, the last 6, the whole word so far) and of the bits of the byte that are known. Their log odds are
   mixed with weights that a gate selects by how much evidence the longest contexts have; an adaptive map refines the
   mixed probability. Its counts are of the distinct words learned from, in tables of a bounded size.
1. The word's share of all words learned from.
2. The word's share of all words that follow the word before it.

The gates' hashed contexts are how often the word before was seen, how often expert 2 has beaten expert 1 at the last words
of this text, and the word before itself. Weights are learned online, on counts without the occurrence at hand. The sum
over all words is the text's length in bits.

Counts of words and of pairs of words are those of the whole corpus and grow with it: documents are dealt to buckets, a
bucket asks for its distinct words and pairs, packed by hash range, and gets the count of each back. The gates learn from all
texts to learn from, in shards of about SHARD_BYTES of text; the mixer of spelling learns from all distinct words, in shards
of about SHARD_WORDS. Shards start alike, learn side by side, and are averaged by the evidence that each has for a
context. Shards and the order within them are drawn by hashes and sizes alone, so no number of partitions changes a score
(but by rounding, and where over a thousandth of all rows are the same, by which of these rows are in which shard).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.common import HOT_KEYS, discard, free_name, n_partitions, release, row_key, set_aside, trim, written

ORDERS = (1, 2, 3, 4, 6, 0)  # bytes of context; 0: the word so far
#: Slots of a predictor of spelling: four for each distinct word, within these bounds. The upper one is the default of a
#: parameter of score(): tables of 2^20 slots are 50 MB in each worker.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 12, 20
#: Longer words are coded in pieces of so many bytes.
PIECE = 40
GATES, CELLS = 64, 33
PRIOR = 0.05
RATE, REFINE_RATE, STEP_WORDS = 0.01, 0.3, 1 << 14
CHUNK_SLOTS = 1 << 12
#: Tokens that are judged at once: what is worked out for them stays near the processor.
CHUNK_TOKENS = 1 << 15
#: The mixer of spelling learns from this share of the distinct words (a default of score()): all of them.
SPELLING_SHARE = 1.0
#: Distinct words, and bytes of text, from which one shard learns; no bucket has more text than a shard, about.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 8 << 20
#: Levels of how often the word before was seen; words of history; slots of the word before.
LEVELS, HISTORY, FORMER_SLOTS = 12, 7, 1 << 10
GATE_RATE, FORMER_RATE, GATE_STEP = 0.5, 0.2, 1024
START_ODDS = (-2.0, 1.0, 0.0)
#: The context of a text's first word.
START = np.uint64(0x5851F42D4C957F2D)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: kind 0: words and how often each is learned from; 1: keys of pairs and the same.
BLOCKS = "kind int, p int, bucket int, keys binary, train binary"
ANSWERS = "kind int, bucket int, p int, counts binary, costs binary"
RESULTS = "n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def tokens(text: str | None) -> list[bytes]:
    """Words, then the empty word as the end."""
    return [*(text or "").encode().lower().split(), b""]


class _Units:
    """Words as rows of bytes; words of over PIECE bytes give several rows, those behind the first at the end.

    All that is looked up for a byte hangs on the bytes up to it, so rows next to each other that begin alike share it: words in
    order are looked up about half as often.
    """

    def __init__(self, words: list[bytes]) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        pieces = -(-lengths // PIECE)
        of = np.repeat(np.arange(len(words)), pieces)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        sizes = np.minimum(PIECE, lengths[of] - at)
        order = np.argsort(at > 0, kind="stable")
        flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        first = (np.cumsum(sizes) - sizes)[order]
        self.sizes, self.of = sizes[order], of[order]
        self.start = np.where(at > 0, 257, 256).astype(np.uint64)[order]
        self.bytes = np.zeros((int(sizes.max(initial=0)), len(of)), np.uint8)
        self.shared = np.zeros(len(of), np.int64)  # first bytes that a row has in common with the row before
        alike, alive = self.start[1:] == 256, np.arange(len(of))
        for i, column in enumerate(self.bytes):
            alive = alive[self.sizes[alive] > i]
            column[alive] = flat[first[alive] + i]
            alike &= column[1:] == column[:-1]
            self.shared[1:] += alike

    def steps(self, slot_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """For each byte in turn: rows that have it, which of the lookups is theirs, and _bits() of the lookups."""
        word, rows = self.start * _MIX[0], np.arange(len(self.of))
        for i, column in enumerate(self.bytes):
            rows = rows[self.sizes[rows] > i]
            new = self.shared[rows] <= i
            own = rows[new]
            hashes, h, start = np.empty((len(ORDERS), len(own)), np.uint64), np.zeros(len(own), np.uint64), self.start[own]
            for back in range(1, max(ORDERS) + 1):
                b = self.bytes[i - back].take(own).astype(np.uint64) if back <= i else start
                h = (h + b + np.uint64(1)) * _MIX[back]
                if back in ORDERS:
                    hashes[ORDERS.index(back)] = h
            hashes[ORDERS.index(0)] = word[own]
            hashes += np.arange(1, len(ORDERS) + 1, dtype=np.uint64)[:, None]
            yield rows, np.cumsum(new) - 1, _bits(hashes, column[own], slot_bits)
            word[rows] = (word[rows] + column[rows] + np.uint64(1)) * _MIX[3]


def _bits(hashes: np.ndarray, own: np.ndarray, slot_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of bytes with these contexts: its values, and the slot of each predictor (predictor, byte)."""
    node = np.ones(len(own), np.uint64)
    for k in range(7, -1, -1):
        mixed = hashes ^ (node * _MIX[0])
        mixed *= _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[2]
        mixed >>= np.uint64(64 - slot_bits)
        bit = own >> k & 1
        yield bit, mixed.view(np.int64)
        node = node << np.uint64(1) | bit


def count_bits(words: list[bytes], slot_bits: int) -> np.ndarray:
    """How often each predictor's slots saw a zero and a one: (predictor, 2, slot); each word counts once."""
    out, words = np.zeros((len(ORDERS), 2 << slot_bits), np.int32), sorted(words)
    for at in range(0, len(words), 1 << 15):
        for _, which, bits in _Units(words[at : at + (1 << 15)]).steps(slot_bits):
            times = np.bincount(which).astype(np.int32)
            for bit, slots in bits:
                place = slots + (bit.astype(np.int64) << slot_bits)
                for k in range(len(ORDERS)):
                    np.add.at(out[k], place[k], times)
    return out.reshape(len(ORDERS), 2, -1)


def _level(total: np.ndarray) -> np.ndarray:
    """Evidence in eight levels."""
    return np.minimum(7, np.log2(total + 1)).astype(np.int16)


@dataclass
class Mixer:
    """counts: (predictor, 2, slot), none if packed(); weights: (gate, predictor); cells: the map's refined log odds (gate, cell)."""

    counts: np.ndarray | None
    weights: np.ndarray
    cells: np.ndarray
    looked_up: tuple | None = None
    held_out: tuple | None = None

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Mixer:
        return cls(counts.astype(np.float32, copy=False), np.full((GATES, len(ORDERS)), 0.3), np.tile(np.linspace(-8, 8, CELLS), (GATES, 1)))

    def packed(self) -> Mixer:
        """The same mixer with what cost() looks up in place of the counts."""
        return Mixer(None, self.weights, self.cells, self._tables(), self._own_tables())

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all slots: log odds (predictor, slot), and the two parts of the gate."""
        if self.looked_up is None:
            zeros, ones = self.counts[:, 0], self.counts[:, 1]
            odds = np.empty_like(zeros)
            for z, o, out in zip(zeros, ones, odds, strict=True):  # one predictor at a time takes less memory
                np.log((o + np.float32(PRIOR)) / (z + np.float32(PRIOR)), out=out)
            self.looked_up = odds, _level(zeros[-3] + ones[-3]), 8 * _level(zeros[-1] + ones[-1])
        return self.looked_up

    def _own_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without the occurrence at hand, a zero or a one: log odds are (predictor, value and slot)."""
        if self.held_out is None:
            zeros, ones = self.counts[:, 0], self.counts[:, 1]
            odds = np.empty_like(self.counts)
            for z, o, out in zip(zeros, ones, odds, strict=True):
                np.log((o + np.float32(PRIOR)) / (np.maximum(z - 1, 0) + np.float32(PRIOR)), out=out[0])
                np.log((np.maximum(o - 1, 0) + np.float32(PRIOR)) / (z + np.float32(PRIOR)), out=out[1])
            low, high = (np.maximum(zeros[k] + ones[k] - 1, 0) for k in (-3, -1))
            self.held_out = odds.reshape(len(ORDERS), -1), _level(low), 8 * _level(high)
        return self.held_out

    @property
    def slot_bits(self) -> int:
        return (self.looked_up[0].shape[1] if self.counts is None else self.counts.shape[2]).bit_length() - 1

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Online, one step for each bit of STEP_WORDS words: weights move by a damped Newton step, the map by its error.

        Gives how many bits each gate and each cell of the map has learned from. Faster if the words are in order.
        """
        met, met_cells = np.zeros(GATES), np.zeros(GATES * CELLS)
        order = np.random.default_rng(len(words)).permutation(len(words))
        weights, cells = self.weights.T.copy(), self.cells.ravel().copy()
        curve, each, step = np.ones_like(weights), np.arange(len(ORDERS))[:, None] * GATES, 0
        for at in range(0, len(order), STEP_WORDS):
            units = _Units([words[i] for i in np.sort(order[at : at + STEP_WORDS])])
            for _, which, bits in units.steps(self.slot_bits):
                times = np.bincount(which).astype(np.float32)
                for bit, slots in bits:
                    odds, gate = _found(self._own_tables(), slots + (bit.astype(np.int64) << self.slot_bits), slots)
                    mixed = _mixed(odds, gate, weights.astype(np.float32))
                    p = 1 / (1 + np.exp(-mixed))
                    error, spread = (bit - p) * times, p * (1 - p) * times
                    held = np.bincount(gate, times, GATES) + 4
                    met += held - 4
                    step += 1
                    places = (each + gate).ravel()
                    if step % 8 == 1:
                        curve += 0.3 * (np.bincount(places, (spread * odds * odds).ravel(), weights.size).reshape(curve.shape) / held - curve)
                    weights += RATE * np.bincount(places, (error * odds).ravel(), weights.size).reshape(curve.shape) / held / (curve + 0.02)
                    place, part, refined = _refined(cells.astype(np.float32), gate, mixed)
                    wrong, high = (bit - 1 / (1 + np.exp(-refined))) * times, part * times
                    flat = np.bincount(place, wrong * (1 - part), len(cells)) + np.bincount(place + 1, wrong * part, len(cells))
                    near = np.bincount(place, times - high, len(cells)) + np.bincount(place + 1, high, len(cells))
                    met_cells += near
                    cells = np.clip(cells + REFINE_RATE * flat / (near + 4), -12, 12)
        self.weights, self.cells = np.ascontiguousarray(weights.T), cells.reshape(GATES, CELLS)
        return met, met_cells

    def cost(self, words: list[bytes], own: bool = False) -> np.ndarray:
        """Bits of each word; if `own`, as if the word itself had not been learned from."""
        out, tables = np.zeros(len(words)), self._own_tables() if own else self._tables()
        weights, cells = np.ascontiguousarray(self.weights.T, np.float32), self.cells.astype(np.float32).ravel()
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        for at in range(0, len(words), 1 << 14):
            own_words = order[at : at + (1 << 14)]
            units = _Units([words[i] for i in own_words.tolist()])
            bits = np.zeros(len(units.of))
            for rows, which, each in units.steps(self.slot_bits):
                cost = 0.0
                for bit, slots in each:
                    odds, gate = _found(tables, slots + (bit.astype(np.int64) << self.slot_bits) if own else slots, slots)
                    mixed = _mixed(odds, gate, weights)
                    refined = _refined(cells, gate, mixed)[2]
                    sign = bit * np.float32(2) - np.float32(1)
                    cost = cost - np.log2((1 / (1 + np.exp(-sign * mixed)) + 1 / (1 + np.exp(-sign * refined))) / 2).astype(np.float64)
                bits[rows] += cost[which]
            np.add.at(out, own_words[units.of], bits)
        return out


def _found(tables: tuple[np.ndarray, np.ndarray, np.ndarray], places: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each predictor's log odds (predictor, row) and each row's gate."""
    odds, low, high = tables
    out = np.empty(places.shape, np.float32)
    for o, p, found in zip(odds, places, out, strict=True):
        o.take(p, out=found, mode="clip")  # other modes make a copy first
    return out, (high.take(slots[-1]) + low.take(slots[-3])).astype(np.intp)


def _mixed(odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    mixed = odds[0] * weights[0].take(gate)
    for o, w in zip(odds[1:], weights[1:], strict=True):
        mixed += o * w.take(gate)
    return np.clip(mixed, -12, 12, out=mixed)


def _refined(cells: np.ndarray, gate: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map's two cells around each row (the lower one, and the share of the upper) and what they give."""
    place = (np.clip(mixed, -7.999, 7.999) + np.float32(8)) * np.float32((CELLS - 1) / 16)
    cell = place.astype(np.intp)
    part = place - cell.astype(np.float32)
    cell += gate * CELLS
    low = cells.take(cell)
    return cell, part, low + part * (cells.take(cell + 1) - low)


class _Vocabulary:
    """A bucket's distinct tokens and pairs in an order that does not depend on how its rows arrive, with the range of each."""

    def __init__(self, rows: pa.Table, text: str, parts: int) -> None:
        self.keys_of = rows.column("_key").to_numpy()
        self.order = np.argsort(self.keys_of, kind="stable")  # equal keys are equal texts
        self.keys_of = self.keys_of[self.order]
        texts = pa.compute.fill_null(rows.column(text).cast(pa.large_string()).take(pa.array(self.order)), "").combine_chunks()
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
        filled = pa.compute.greater(pa.compute.binary_length(split.flatten()), 0)
        of = pa.compute.list_parent_indices(split).filter(filled).to_numpy()
        coded = split.flatten().filter(filled).dictionary_encode()
        self.words = [b"", *_each(coded.dictionary)]
        self.sizes = np.bincount(of, minlength=len(self.order)) + 1
        self.found = np.zeros(len(of) + len(self.order), np.int32)
        self.found[np.arange(len(of)) + of] = coded.indices.to_numpy() + 1  # each text before it has its end
        self.learned = rows.column("_train").to_numpy(zero_copy_only=False).astype(bool)[self.order]
        del texts, split, filled, of, coded
        self.first = np.cumsum(self.sizes) - self.sizes
        self.former = np.empty_like(self.found)  # the token before; that of a text's first token is its end
        if len(self.order):
            self.former[1:] = self.found[:-1]
            self.former[self.first] = 0
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        part = (self.hashes * _MIX[5] >> np.uint64(33)) % np.uint64(parts)
        self.by = np.argsort(_small(part, parts), kind="stable")
        self.parts, first = np.unique(part[self.by], return_index=True)
        self.cuts = np.append(first, len(self.by))

    def _pairs(self) -> np.ndarray:
        """Each token's pair as a key of 48 bits."""
        pair = (self._former_hashes() * _MIX[1] ^ self.hashes[self.found]) * _MIX[0]
        pair ^= pair >> np.uint64(31)
        pair *= _MIX[2]
        pair >>= np.uint64(16)
        return pair

    def pairs(self, parts: int) -> None:
        """Keys of the distinct pairs, by range, and which of them each token has."""
        self.keys, self.pair_of = _numbered(self._pairs())
        self._deal(parts)

    def counted_pairs(self, parts: int, learned: np.ndarray) -> np.ndarray:
        """Keys of the distinct pairs, by range; gives how often each is learned from."""
        self.keys, seen = _counted(self._pairs(), learned)
        self._deal(parts)
        return seen

    def _deal(self, parts: int) -> None:
        part = (self.keys * _MIX[3] >> np.uint64(33)) % np.uint64(parts)
        self.pairs_by = np.argsort(_small(part, parts), kind="stable")
        self.pair_parts, first = np.unique(part[self.pairs_by], return_index=True)
        self.pair_cuts = np.append(first, len(self.pairs_by))

    def _former_hashes(self) -> np.ndarray:
        out = self.hashes[self.former]
        out[self.first] = START
        return out

    def former_slots(self) -> np.ndarray:
        return (self._former_hashes() * _MIX[4] >> np.uint64(64 - FORMER_SLOTS.bit_length() + 1)).astype(np.int64)

    def word_runs(self) -> Iterator[tuple[int, np.ndarray]]:
        for p, i, j in zip(self.parts.tolist(), self.cuts[:-1], self.cuts[1:], strict=True):
            yield p, self.by[i:j]

    def pair_runs(self) -> Iterator[tuple[int, np.ndarray]]:
        for p, i, j in zip(self.pair_parts.tolist(), self.pair_cuts[:-1], self.pair_cuts[1:], strict=True):
            yield p, self.pairs_by[i:j]


def _each(texts: pa.LargeStringArray) -> list[bytes]:
    """As to_pylist() of their bytes, but cut from one buffer, which is faster."""
    if not len(texts):
        return []
    _, places, data = texts.buffers()
    cuts = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset).tolist()
    data = data.to_pybytes()
    return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() of keys of 48 bits, with the inverse: values are sorted, their places in the low bits, which is faster than to sort places."""
    low = np.uint64(max(16, (len(keys) - 1).bit_length()))
    mixed = keys << np.uint64(16) >> low << low
    mixed |= np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    place = (mixed & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    own = keys[place]
    if (own[1:] < own[:-1]).any():  # keys that differ in the bits that were cut off
        return np.unique(keys, return_inverse=True)
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    which = np.empty(len(keys), np.int64)
    which[place] = np.cumsum(new) - 1
    return own[new], which


def _counted(keys: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of 48 bits in order, and how often each is learned from."""
    mixed = keys << np.uint64(1) | learned
    mixed.sort()
    own = mixed >> np.uint64(1)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(mixed & np.uint64(1), first)


def _small(part: np.ndarray, parts: int) -> np.ndarray:
    """Numbers below parts, in 16 bits where they fit: those are sorted faster."""
    return part.astype(np.uint16) if parts <= 1 << 16 else part


def _packed(keys: np.ndarray) -> bytes:
    """Keys of 48 bits in 6 bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


@dataclass
class Gates:
    """Log odds of the experts: (level and history, expert) and (slot of the word before, expert)."""

    by_level: np.ndarray
    by_former: np.ndarray

    @classmethod
    def fresh(cls) -> Gates:
        return cls(np.tile(START_ODDS, (LEVELS * HISTORY, 1)).astype(np.float64), np.zeros((FORMER_SLOTS, 3)))

    def weights(self, gate: np.ndarray, former: np.ndarray) -> np.ndarray:
        """Each expert's weight: (expert, token)."""
        out = np.stack([self.by_level[:, k].take(gate) + self.by_former[:, k].take(former) for k in range(3)])
        np.exp(out, out=out)
        out /= out[0] + out[1] + out[2]
        return out

    def bits(self, experts: np.ndarray, gate: np.ndarray, former: np.ndarray) -> np.ndarray:
        """log2 of the probability that all experts together give each token."""
        out = np.empty(len(gate))
        for at in range(0, len(gate), CHUNK_TOKENS):
            own = slice(at, at + CHUNK_TOKENS)
            most, shares = _scaled(experts[own])
            shares *= self.weights(gate[own], former[own])
            out[own] = most + np.log2(shares[0] + shares[1] + shares[2])
        return out

    def learn(self, experts: np.ndarray, gate: np.ndarray, former: np.ndarray) -> None:
        """Online, GATE_STEP tokens at a time: each weight moves towards the expert's share in the tokens' probability."""
        shares, by_level, by_former = _scaled(experts)[1], self.by_level.T.copy(), self.by_former.T.copy()
        each = np.arange(3)[:, None]
        tables = [(by_level, gate, GATE_RATE, 4), (by_former, former, FORMER_RATE, 8)]
        for at in range(0, len(gate), GATE_STEP):
            own = slice(at, at + GATE_STEP)
            weights = by_level.take(gate[own], 1)
            weights += by_former.take(former[own], 1)
            np.exp(weights, out=weights)
            weights /= weights[0] + weights[1] + weights[2]
            wrong = shares[:, own] * weights
            wrong /= wrong[0] + wrong[1] + wrong[2]
            wrong -= weights
            for table, which, rate, held in tables:
                size = table.shape[1]
                moved = np.bincount((each * size + which[own]).ravel(), wrong.ravel(), table.size).reshape(table.shape)
                moved *= rate / (np.bincount(which[own], minlength=size) + held)
                table += moved
        self.by_level, self.by_former = np.ascontiguousarray(by_level.T), np.ascontiguousarray(by_former.T)
        np.clip(self.by_level, -12, 12, out=self.by_level)
        np.clip(self.by_former, -6, 6, out=self.by_former)


def _mean(rows: DataFrame, values: str, weights: str, shape: tuple[int, int]) -> np.ndarray | None:
    """The weighed mean of arrays, place by place; None where there are none. The arrays are of a fixed length."""
    each = rows.select(F.posexplode(F.arrays_zip(F.col(values).alias("v"), F.col(weights).alias("w"))).alias("place", "x"))
    found = each.groupBy("place").agg((F.sum(F.col("x.v") * F.col("x.w")) / F.sum("x.w")).alias("mean")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in found:
        out[r.place] = r["mean"]
    return out.reshape(shape) if found else None


def _spread(evidence: np.ndarray, n: int) -> list[float]:
    """Evidence of contexts for each of their n values; one occurrence more, so that contexts never met keep their start."""
    return np.repeat(evidence + 1.0, n).tolist()


def _scaled(experts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest log2 of each token's probabilities, and all of them as shares of that one: (expert, token)."""
    most = np.maximum(np.maximum(experts[:, 0], experts[:, 1]), experts[:, 2])
    return most, np.exp2(experts.T - most)


def _experts(costs: np.ndarray, words: np.ndarray, pairs: np.ndarray, formers: np.ndarray, n: int) -> np.ndarray:
    """log2 of the probability that each expert gives each token: (token, expert)."""
    with np.errstate(divide="ignore"):
        out = np.empty((3, len(costs)))
        np.negative(costs, out=out[0])
        np.log2(np.divide(words, max(n, 1), out=out[1]), out=out[1])
        np.log2(np.divide(pairs, np.maximum(formers, 1), out=out[2]), out=out[2])
        return out.T


def _gates_of(experts: np.ndarray, formers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Level and history of each token; a history is of the tokens before it in its text, HISTORY - 1 at most."""
    won = np.concatenate([[0], np.cumsum(experts[:, 2] > experts[:, 1])])
    place = np.arange(len(formers))
    sizes = np.diff(np.append(first, len(formers)))
    since = np.maximum(place - (HISTORY - 1), np.repeat(first, sizes))
    level = np.minimum(LEVELS - 1, np.log2(formers + 1).astype(np.int64))
    return level * HISTORY + won[place] - won[since]


def score(docs: DataFrame, train: Column, text: str = "text", id_col: str = "doc_id", spelling_share: float = SPELLING_SHARE, slot_bits: int = MOST_SLOT_BITS) -> DataFrame:
    """docs with n_tokens, n_known, base_score and score (log10 probabilities), bits_per_byte, and train_tokens.

    Rows where train is true are learned from: all of them, each token and pair of each. A null text counts as empty and has
    its end alone; a null in train counts as false; repeated rows count each. Without rows to learn from all bits have a
    probability of 1/2. bits_per_byte is over the bytes of all tokens and a blank after each, so an empty text has one byte.
    spelling_share is the share of distinct words that the mixer of spelling learns from (its counts are of all), 2^slot_bits
    the most slots of a predictor. Columns with the names of the results are replaced, other columns stay; no rows give no rows.
    """
    spark = docs.sparkSession
    names = [*[x.split()[0] for x in RESULTS.split(", ")], "train_tokens"]
    learns = free_name(docs, "_train")
    marked = docs.withColumn(learns, F.coalesce(train, F.lit(False)))
    keep, back = set_aside(marked.drop(*[c for c in docs.columns if c in names]), text, id_col, learns)
    keyed = keep.withColumnRenamed(learns, "_train").withColumn("_key", row_key(id_col, text))
    keyed, size = _salted(keyed, text)
    shards = max(1, -(-size // SHARD_BYTES))
    split = max(1, n_partitions(spark) // shards)  # buckets of a shard
    parts = max(n_partitions(spark), shards)
    bucket = F.pmod(F.xxhash64("_key", "_salt", F.lit("shard")), F.lit(shards)) * split + F.pmod(F.xxhash64("_key", "_salt"), F.lit(split))
    dealt = keyed.withColumn("_bucket", bucket.cast("int")).drop("_salt").repartition(parts, "_bucket")
    columns = [c for c in keep.columns if c != learns]
    schema = T.StructType([*[f for f in keep.schema.fields if f.name != learns], *T._parse_datatype_string(RESULTS).fields])

    def ask(rows: pa.Table) -> pa.Table:
        v, own = _Vocabulary(rows, text, parts), rows.column("_bucket")[0].as_py()
        learned = np.repeat(v.learned, v.sizes)
        seen = np.bincount(v.found[learned], minlength=len(v.words)).astype(np.uint32)
        out = [(0, p, own, b" ".join([v.words[k] for k in which.tolist()]), seen[which].tobytes()) for p, which in v.word_runs()]
        seen = v.counted_pairs(parts, learned).astype(np.uint32)
        out += [(1, p, own, _packed(v.keys[which]), seen[which].tobytes()) for p, which in v.pair_runs()]
        del v
        trim()
        return _table(out, BLOCKS)

    def settle(rows: pa.Table) -> pa.Table:
        """Pairs are answered at once; words wait until all have been counted."""
        pairs = rows.filter(pa.compute.equal(rows.column("kind"), 1))
        asked = [_unpacked(b) for b in pairs.column("keys").to_pylist()]
        out = []
        if asked:
            which = _numbered(np.concatenate(asked))[1]
            counts = np.bincount(which, np.concatenate([np.frombuffer(b, np.uint32) for b in pairs.column("train").to_pylist()]))
            found = np.split(np.minimum(counts, (1 << 32) - 1).astype(np.uint32)[which], np.cumsum([*map(len, asked)])[:-1])
            out = [(1, p, bucket, None, x.tobytes()) for p, bucket, x in zip(pairs.column("p").to_pylist(), pairs.column("bucket").to_pylist(), found, strict=True)]
            del asked, which, counts, found
        words = rows.filter(pa.compute.equal(rows.column("kind"), 0))
        types = _table([], BLOCKS).schema
        trim()
        return pa.concat_tables([_table(out, BLOCKS), pa.Table.from_arrays([words.column(f.name).cast(f.type) for f in types], schema=types)])

    asked = dealt.select(text, "_key", "_train", "_bucket").groupBy("_bucket").applyInArrow(ask, BLOCKS)
    blocks = written(asked.groupBy("p").applyInArrow(settle, BLOCKS), "blocks", ("kind",))
    release(spark)
    words = blocks.where("kind = 0").drop("kind")
    pairs = blocks.where("kind = 1").select(F.lit(1).alias("kind"), "bucket", "p", F.col("train").alias("counts"), F.lit(None).cast("binary").alias("costs"))

    def total(rows: pa.Table) -> pa.Table:
        words, counts, _ = _summed(rows)
        known = np.flatnonzero(counts)
        out = [(b" ".join([words[k] for k in known.tolist()]), int(counts.sum()), len(known))]
        del words, counts, known
        trim()
        return _table(out, "words binary, n long, v long")

    vocabulary = written(words.groupBy("p").applyInArrow(total, "words binary, n long, v long"), "vocabulary")
    n, distinct = (x or 0 for x in vocabulary.agg(F.sum("n"), F.sum("v")).first())
    model = _spelling(vocabulary.where("v > 0").select("words"), distinct, spelling_share, slot_bits)

    def answer(rows: pa.Table) -> pa.Table:
        words, counts, places = _summed(rows)
        cost = model.value.cost(words).astype(np.float32)
        out = [(0, bucket, p, counts[which].tobytes(), cost[which].tobytes()) for p, bucket, which in zip(rows.column("p").to_pylist(), rows.column("bucket").to_pylist(), places, strict=True)]
        del words, counts, cost, places
        trim()
        return _table(out, ANSWERS)

    answers = written(words.groupBy("p").applyInArrow(answer, ANSWERS), "answers").unionByName(pairs)
    discard(vocabulary)
    release(spark)

    def known(rows: pa.Table, answers: pa.Table) -> tuple[_Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
        """The bucket with the counts and the costs of its words, and the counts of its pairs."""
        v = _Vocabulary(rows, text, parts)
        v.pairs(parts)
        got = {(k, p): (a, b) for k, p, a, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "p", "counts", "costs")), strict=True)}
        counts, costs, pairs = np.zeros(len(v.words), np.int64), np.zeros(len(v.words)), np.zeros(len(v.keys), np.int64)
        for p, which in v.word_runs():
            counts[which], costs[which] = np.frombuffer(got[0, p][0], np.int64), np.frombuffer(got[0, p][1], np.float32)
        for p, which in v.pair_runs():
            pairs[which] = np.frombuffer(got[1, p][0], np.uint32)
        return v, counts, costs, pairs

    def fit(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """What one shard learns of the gates, and how many tokens each of their contexts had."""
        gates, found = Gates.fresh(), []
        for own in np.unique(rows.column("_bucket").to_numpy()).tolist() if n > 1 else ():
            one = split == 1  # then the shard is the bucket
            v, counts, costs, pairs = known(rows, answers) if one else known(rows.filter(pa.compute.equal(rows.column("_bucket"), own)), answers.filter(pa.compute.equal(answers.column("bucket"), own)))
            learned, sizes = np.repeat(v.learned, v.sizes), v.sizes[v.learned]
            if not len(sizes):
                continue
            tokens, former, last = v.found[learned], v.former[learned], np.cumsum(sizes)
            alone = np.unique(tokens[counts[tokens] == 1])
            costs[alone] = model.value.cost([v.words[i] for i in alone.tolist()], own=True)
            formers = counts[former] - 1
            experts = _experts(costs[tokens], counts[tokens] - 1, pairs[v.pair_of[learned]] - 1, formers, n - 1)
            gate, slots = _gates_of(experts, formers, last - sizes), v.former_slots()[learned]
            found.append((v.keys_of[v.learned], sizes, experts, gate, slots))
            del v, counts, costs, pairs, formers, tokens, former, learned
        keys, sizes, experts, gate, slots = found[0] if len(found) == 1 else map(np.concatenate, zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64))
        if len(found) > 1:  # the texts of one bucket are in order
            order, first = np.argsort(keys, kind="stable"), np.cumsum(sizes) - sizes
            sizes = sizes[order]
            place = np.repeat(first[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(gate))
            experts, gate, slots = experts[place], gate[place], slots[place]
        del found
        gates.learn(experts, gate, slots)
        met = np.bincount(gate, minlength=LEVELS * HISTORY), np.bincount(slots, minlength=FORMER_SLOTS)
        trim()
        return pa.table({"odds": [np.concatenate([gates.by_level.ravel(), gates.by_former.ravel()])], "met": [np.concatenate([_spread(x, 3) for x in met])]})

    shard = F.floor(F.col("_bucket") / split) if split > 1 else F.col("_bucket")
    learners = dealt.select(text, "_key", "_train", "_bucket").groupBy(shard.alias("_shard"))
    own = answers.groupBy((F.floor(F.col("bucket") / split) if split > 1 else F.col("bucket")).alias("_shard"))
    fitted = written(learners.cogroup(own).applyInArrow(fit, "odds array<double>, met array<double>"), "gates")
    release(spark)
    odds = _mean(fitted, "odds", "met", (LEVELS * HISTORY + FORMER_SLOTS, 3))
    gates = Gates.fresh() if odds is None else Gates(odds[: LEVELS * HISTORY], odds[LEVELS * HISTORY :])
    discard(fitted)
    model.destroy()
    release(spark)

    def judge(rows: pa.Table, answers: pa.Table) -> pa.Table:
        types = _arrow(schema)
        if not rows.num_rows:
            return pa.Table.from_pylist([], schema=types)
        v, counts, costs, pairs = known(rows, answers)
        formers = counts[v.former]
        experts = _experts(costs[v.found], counts[v.found], pairs[v.pair_of], formers, n)
        logs = gates.bits(experts, _gates_of(experts, formers, v.first), v.former_slots()) if n else experts[:, 0]
        base = np.add.reduceat((np.log10(counts + 0.1) - np.log10(n + 0.1 * (distinct + 1)))[v.found], v.first)
        seen = np.add.reduceat((counts > 0)[v.found].astype(np.int64), v.first)
        bits, lengths = -np.add.reduceat(logs, v.first), np.fromiter(map(len, v.words), np.int64, len(v.words)) + 1
        bytes_ = np.add.reduceat(lengths[v.found], v.first)
        results = [pa.array(v.sizes, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / bytes_)]
        kept = rows.take(pa.array(v.order)).select(columns)
        del v, counts, costs, pairs, formers, experts, logs
        trim()
        return pa.Table.from_arrays([*[kept.column(c).cast(types.field(i).type) for i, c in enumerate(columns)], *results], schema=types)

    scored = dealt.groupBy("_bucket").cogroup(answers.groupBy("bucket")).applyInArrow(judge, schema)
    return back(scored, *names[:-1]).withColumn("train_tokens", F.lit(n).cast("long"))


def _words(blob: bytes) -> list[bytes]:
    return blob.split(b" ")


def _summed(rows: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Distinct words of all blocks with their counts, and which of them each block has."""
    place: dict[bytes, int] = {}
    take, which = place.setdefault, []
    for blob in rows.column("keys"):
        own = _words(blob.as_py())
        which.append(np.fromiter((take(w, len(place)) for w in own), np.int32, len(own)))
    train = [np.frombuffer(b, np.uint32) for b in rows.column("train").to_pylist()]
    return [*place], np.bincount(np.concatenate(which), np.concatenate(train), len(place)).astype(np.int64), which


def _salted(keyed: DataFrame, text: str) -> tuple[DataFrame, int]:
    """keyed with _salt, and the bytes of all texts. Only keys of over 1/HOT_KEYS of all rows, fewer than HOT_KEYS, get a salt.

    Salts are numbers of rows, which another reading may give to other rows, so rows that have some are written first.
    """
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes"))
    total, size, most = (x or 0 for x in counts.agg(F.sum("rows"), F.sum("bytes"), F.max("rows")).first())
    least = max(total // HOT_KEYS, 64)
    hot = [r["_key"] for r in counts.where(F.col("rows") > least).select("_key").collect()] if most > least else []  # fewer than HOT_KEYS
    if not hot:
        return keyed.withColumn("_salt", F.lit(None).cast("long")), size
    return written(keyed.withColumn("_salt", F.when(F.col("_key").isin(hot), F.monotonically_increasing_id())), "salted"), size


def _spelling(vocabulary: DataFrame, distinct: int, share: float, most_bits: int) -> Broadcast[Mixer]:
    """The mixer of spelling: counts over all words; weights and map learned from all of them, or a share drawn by a hash, in shards."""
    context = vocabulary.sparkSession.sparkContext
    slot_bits = min(most_bits, max(LEAST_SLOT_BITS, (4 * distinct).bit_length()))
    spread = vocabulary.repartition(max(1, distinct >> 18))
    bound, shards = int((1 << 64) * share), max(1, -(-int(distinct * share) // SHARD_WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(ORDERS), 2, 1 << slot_bits), np.int32)
        for b in batches:
            for blob in b.column("words").to_pylist():
                out += count_bits(_words(blob), slot_bits)
        own = out.reshape(-1, CHUNK_SLOTS)
        for at in range(0, len(own), 256):
            sums = [_narrow(x) for x in own[at : at + 256]]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(at, at + len(sums)), pa.int32()), "sums": pa.array(sums, pa.binary())})
        del out, own
        trim()

    def add(rows: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK_SLOTS, np.int64)
        for x in rows.column("sums").to_pylist():
            out += np.frombuffer(x, f"u{len(x) // CHUNK_SLOTS}")
        return pa.table({"part": rows.column("part").slice(0, 1).combine_chunks(), "sums": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("words").to_pylist():
                dealt: dict[int, list[bytes]] = {}
                for w in _words(blob):
                    if (h := xxhash.xxh64_intdigest(w, 1)) < bound:
                        dealt.setdefault(h % shards, []).append(w)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([*dealt], pa.int32()), "words": pa.array([b" ".join(x) for x in dealt.values()], pa.binary())})

    counts = np.zeros((len(ORDERS) * 2 << slot_bits) // CHUNK_SLOTS * CHUNK_SLOTS, np.float32).reshape(-1, CHUNK_SLOTS)
    for r in spread.mapInArrow(count, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").toLocalIterator():  # 48 << slot_bits bytes at most
        counts[r.part] = np.frombuffer(r.sums, np.float32)
    start = context.broadcast(Mixer.fresh(counts.reshape(len(ORDERS), 2, -1)))

    def learn(rows: pa.Table) -> pa.Table:
        own = Mixer.fresh(start.value.counts)
        own.held_out = start.value._own_tables()  # once a worker
        met, met_cells = own.learn(sorted({w for blob in rows.column("words").to_pylist() for w in _words(blob)}))
        values, seen = np.concatenate([own.weights.ravel(), own.cells.ravel()]), np.concatenate([_spread(met, len(ORDERS)), _spread(met_cells, 1)])
        trim()
        return pa.table({"odds": [values], "met": [seen]})

    drawn = vocabulary.mapInArrow(draw, "shard int, words binary").groupBy("shard")
    fitted = written(drawn.applyInArrow(learn, "odds array<double>, met array<double>"), "spelling")
    odds = _mean(fitted, "odds", "met", (GATES * (len(ORDERS) + CELLS), 1))
    discard(fitted)
    mixer = Mixer.fresh(start.value.counts)
    if odds is not None:
        mixer.weights, mixer.cells = (x.reshape(GATES, -1) for x in np.split(odds.ravel(), [GATES * len(ORDERS)]))
    start.destroy()
    return context.broadcast(mixer.packed())


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 1, 2 or 4 bytes each, as the largest needs."""
    most = int(counts.max())
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.types)], schema=types)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
