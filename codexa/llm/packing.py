"""Best-fit packing of tokenised documents into sequences by bin completion (branch and bound).

Around the largest document left, the search enumerates the fillings of the rest of its sequence that no other filling
dominates, tries the fullest first, and gives up a branch as soon as the waste so far exceeds what a better solution
than the incumbent could afford. The incumbent is a best-fit-decreasing packing, and the search ends at the lower bound
on sequences or after a number of nodes that grows with the sequences. The worst filled sequences are searched first, more
of them each time, and all of them last.

Each task packs the pieces of its own rows in chunks of bounded size and carries the pieces of badly filled sequences into
its next chunk; what is still badly filled at its end, about one sequence a task, is packed in a second round together with
that of all other tasks. Only these pieces are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.bpe import encoder
from codexa.llm.common import slices, written

CAPACITY = 4096
END_ID = 1
#: Tokens that a task packs at once.
CHUNK_TOKENS = 3 << 20
#: Nodes of one search, and nodes more for each sequence of the incumbent: a dive needs one a sequence. Beyond them the incumbent stands.
NODES, NODES_A_SEQUENCE = 1500, 4
#: Fillings tried at one node where over FEW documents fit, and the leaves for each and the branches at each document of their search.
#: A search that ends with nodes to spare is repeated with WIDER times as many, up to MOST_FILLINGS.
FILLINGS, FEW, TRIES, BRANCHES, WIDER, MOST_FILLINGS = 8, 10, 6, 3, 4, 2048
#: A chunk's sequences with more free tokens than this share of a sequence go on to the task's next chunk.
CARRY_WASTE = 1 / 64
#: The worst filled sequences that are searched first, and how many times as many next.
WORST, WORST_WIDER = 16, 4
#: Sequences of the second round are numbered from here.
SECOND_ROUND = 1 << 62

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences at least: by total, and by documents over half a sequence, of which no two share one."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of each sequence."""
    room: list[tuple[int, int]] = []  # (free, sequence), sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        free, k = room.pop(at) if at < len(room) else (capacity, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
        insort(room, (free - lengths[i], k))
    return bins


def dominated(small: tuple[int, ...], big: tuple[int, ...]) -> bool:
    """Whether the documents of `small` fit into spaces of the sizes in `big`: then `big` is never the worse choice."""
    if not small:
        return True
    return any(small[0] <= b and dominated(small[1:], tuple(sorted((*big[:i], b - small[0], *big[i + 1 :]), reverse=True))) for i, b in enumerate(big))


def _best_few(s: np.ndarray, c: np.ndarray, gap: int, most: int) -> list[tuple[int, ...]]:
    """The fullest pairs, and the largest documents with the best pair below each."""
    found = [(int(s[-1]),)]
    at = np.arange(len(s))
    second = np.searchsorted(s, gap - s, side="right") - 1  # the largest partner that fits
    second = np.where((second == at) & (c == 1), second - 1, second)
    ok = np.flatnonzero((second >= 0) & (second <= at))
    for i in ok[np.argsort(-(s[ok] + s[second[ok]]), kind="stable")[:most]].tolist():
        found.append((int(s[i]), int(s[second[i]])))
    for i in range(len(s) - 1, max(-1, len(s) - 1 - most // 2), -1):
        left = gap - s[i]
        low = s[: i + 1]
        low = low[low <= left]
        if len(low):
            third = np.searchsorted(low, left - low, side="right") - 1
            good = np.flatnonzero(third >= 0)
            if len(good):
                best = good[np.argmax(low[good] + low[third[good]])]
                trio = tuple(sorted((int(s[i]), int(low[best]), int(low[third[best]])), reverse=True))
                if all(trio.count(x) <= c[np.searchsorted(s, x)] for x in trio):
                    found.append(trio)
    return found


def fillings(sizes: np.ndarray, counts: np.ndarray, gap: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated sets of any number of documents that fit into gap, the fullest first. sizes: ascending, each once.

    All of them where at most FEW documents fit; else `most`, of the best pairs and triples and of those that a depth-first
    search finds in TRIES leaves for each wanted.
    """
    have = np.flatnonzero(counts[: np.searchsorted(sizes, gap, side="right")] > 0)
    s, c = sizes[have].tolist(), counts[have].tolist()
    few = sum(c) <= FEW
    found = [] if few else _best_few(sizes[have], counts[have], gap, most)
    chosen: list[int] = []
    tries, branches_each = TRIES * most, BRANCHES * most // FILLINGS

    def extend(at: int, gap: int) -> None:
        nonlocal tries
        i, branches = min(at, bisect_right(s, gap) - 1), 0
        while i >= 0 and (few or branches < branches_each and tries > 0):
            if c[i]:
                branches += 1
                c[i] -= 1
                chosen.append(s[i])
                extend(i, gap - s[i])
                chosen.pop()
                c[i] += 1
            i -= 1
        if not branches:
            tries -= 1
            if not any(c[: bisect_right(s, gap)]):  # else it could hold one more
                found.append(tuple(chosen))

    extend(len(s) - 1, gap)
    ranked = sorted(set(found), key=lambda f: (-sum(f), len(f), f))
    out = [f for i, f in enumerate(ranked) if len(f) > 4 or not any(len(g) <= 4 and dominated(f, g) for g in ranked[:i])]
    return out if few else out[:most]


def complete_bins(lengths: list[int], capacity: int, nodes: int = NODES, whole: bool = True) -> list[list[int]]:
    """Indices of the documents of each sequence; no sequence exceeds the capacity, each index occurs once.

    Unless whole, the search stays within the sequences that have more than CARRY_WASTE free.
    """
    if not lengths:
        return []
    best = best_fit(lengths, capacity)
    least, size = lower_bound(lengths, capacity), WORST
    free = lambda own: capacity - sum(lengths[i] for i in own)
    while len(best) > least:
        best.sort(key=free, reverse=True)
        most = len(best) if whole else sum(free(b) > capacity * CARRY_WASTE for b in best)
        size = min(size, most)
        own = [i for b in best[:size] for i in b]
        found = _completed([lengths[i] for i in own], capacity, best[:size], own, nodes if size == len(best) else nodes // 8)
        better = len(found) < size
        best = found + best[size:]
        if not better:
            if size == most:
                break
            size *= WORST_WIDER
    return best


def _completed(lengths: list[int], capacity: int, bins: list[list[int]], names: list[int], nodes: int) -> list[list[int]]:
    """bins, or fewer, of the documents with these lengths and names."""
    least, total, width = lower_bound(lengths, capacity), sum(lengths), FILLINGS
    place = {n: i for i, n in enumerate(names)}
    best = [[place[i] for i in b] for b in bins]
    nodes += NODES_A_SEQUENCE * len(best)
    while nodes > 0 and len(best) > least and width <= MOST_FILLINGS:
        best, nodes = _search(lengths, capacity, best, least, total, nodes, width)
        if len(lengths) <= FEW:  # no filling was left out
            break
        width *= WIDER
    return [[names[i] for i in b] for b in best]


def _search(lengths: list[int], capacity: int, best: list[list[int]], least: int, total: int, nodes: int, width: int) -> tuple[list[list[int]], int]:
    """The best packing found by branch and bound, and the nodes that it left over."""
    sizes, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    place = {int(v): i for i, v in enumerate(sizes)}
    taken: list[tuple[int, ...]] = []
    left, waste = len(lengths), 0
    stack: list[tuple[Iterator[tuple[int, ...]], int]] = []

    def open_bin() -> tuple[Iterator[tuple[int, ...]], int]:
        big = int(sizes[np.flatnonzero(counts)[-1]])
        counts[place[big]] -= 1
        out = fillings(sizes, counts, capacity - big, width)
        counts[place[big]] += 1
        return iter([(big, *f) for f in out]), len(taken)

    stack.append(open_bin())
    while stack and nodes > 0 and len(best) > least:
        tries, depth = stack[-1]
        while len(taken) > depth:
            for x in taken[-1]:
                counts[place[x]] += 1
            left += len(taken[-1])
            waste -= capacity - sum(taken.pop())
        chosen = next(tries, None)
        if chosen is None:
            stack.pop()
            continue
        nodes -= 1
        if waste + capacity - sum(chosen) > (len(best) - 1) * capacity - total:
            continue
        for x in chosen:
            counts[place[x]] -= 1
        taken.append(chosen)
        left -= len(chosen)
        waste += capacity - sum(chosen)
        if left:
            stack.append(open_bin())
        elif len(taken) < len(best):
            spare: dict[int, list[int]] = {}
            for i, n in enumerate(lengths):
                spare.setdefault(n, []).append(i)
            best = [[spare[x].pop() for x in b] for b in taken]
    return best, nodes


def _rows(done: list, part: int | None) -> pa.RecordBatch:
    """done: (sequence, offset, doc_id, piece, start, ids). Without a part the pieces have no sequence yet."""
    return pa.RecordBatch.from_arrays([
        pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int32()), pa.array([d[4] for d in done], pa.int64()),
        pa.array([len(d[5]) for d in done], pa.int64()), pa.array([d[5].astype("<u4").tobytes() for d in done], pa.binary()),
        pa.array([None if part is None else part << 33 | d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
    ], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])


class _Packer:
    """Packs a task's pieces (doc_id, piece, start, ids) chunk by chunk; `wait` holds those that have no sequence yet."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.part = capacity, TaskContext.get().partitionId()
        self.wait: list[tuple] = []
        self.sequence = self.held = 0

    def add(self, piece: tuple) -> None:
        self.wait.append(piece)
        self.held += len(piece[3])

    def pack(self, last: bool, most: int | None = None) -> list[tuple]:
        """Rows of filled sequences; of all, if last. About `most` pieces wait on, or half, so that no task holds ever more."""
        done, carry, most = [], [], len(self.wait) // 2 if most is None else most
        for own in complete_bins([len(w[3]) for w in self.wait], self.capacity, whole=last):
            if not last and self.capacity - sum(len(self.wait[i][3]) for i in own) > self.capacity * CARRY_WASTE and len(carry) < most:
                carry += [self.wait[i] for i in own]
                continue
            at = 0
            for i in own:
                done.append((self.sequence, at, *self.wait[i]))
                at += len(self.wait[i][3])
            self.sequence += 1
        self.wait = carry
        self.held = sum(len(w[3]) for w in carry)
        return done


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their tokens and their place in a sequence.

    A document is its tokens and end_id; only one longer than a sequence is cut, into pieces of `capacity` tokens of
    which the last may be shorter. Returns doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id
    and offset; within a sequence, pieces follow each other without gaps. A null text counts as empty and is packed as
    end_id alone; rows with equal or null doc_id are packed each; other columns are ignored; no rows give no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, most = encoder(path), _Packer(capacity), CHUNK_TOKENS
        for b in slices(batches, "text", 4 << 20):
            whole: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), bpe.encode_batch(b.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = doc_id, k, at, ids[at : at + capacity]
                    if len(piece[3]) == capacity:
                        whole.append((packer.sequence, 0, *piece))
                        packer.sequence += 1
                    else:
                        packer.add(piece)
            if whole:
                yield _rows(whole, packer.part)
            if packer.held >= most:
                yield _rows(packer.pack(False), packer.part)
                most = CHUNK_TOKENS + packer.held  # what is carried doesn't count
        bpe.release()
        yield _rows(packer.pack(False, len(packer.wait)), packer.part)
        yield _rows([(0, 0, *w) for w in packer.wait], None)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity)
        for b in batches:
            for doc_id, piece, start, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")), strict=True):
                packer.add((doc_id, piece, start, np.frombuffer(ids, "<u4")))
        yield _rows(packer.pack(True), SECOND_ROUND >> 33 | packer.part)

    packed = written(docs.select("doc_id", "text").mapInArrow(first, SCHEMA), "packed")
    left = packed.where("sequence_id IS NULL")
    tokens = left.agg(F.sum("length")).first()[0]
    if not tokens:
        return packed
    again = left.repartition(-(-tokens // CHUNK_TOKENS)).mapInArrow(second, SCHEMA)
    return packed.where("sequence_id IS NOT NULL").unionByName(again)
