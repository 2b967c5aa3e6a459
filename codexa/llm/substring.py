"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal
removal intervals.

Documents are dealt to buckets by their own hash, one shuffle of the texts that both passes read. The first pass hashes
all windows of a bucket at once (a polynomial of word hashes, rolled over the word stream) and sends, packed by hash
range, one 8-byte hash for each window that no document of the same bucket with a smaller id has too. For each hash range a
task finds the smallest document of each hash and answers with one bit a window. The second pass hashes its bucket
again, lays the bits over the windows and cuts. A window that occurs everywhere costs its range one hash a bucket.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.common import n_partitions, row_key, set_aside

WINDOW = 13
#: Multiplier of the rolling polynomial, odd (64-bit golden ratio).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A missing id comes after all others.
LAST_ID = np.iinfo(np.int64).max
CACHE_WORDS = 200_000
BLOCKS = "p int, bucket int, ids binary, counts binary, hashes binary"
FLAGS = "bucket int, p int, bits binary"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("stop", T.LongType(), False)]), False)
RESULTS = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("removed", SPANS, False), T.StructField("kept_text", T.StringType(), False)])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 9)
        return h


_hash_of = _WordHashes()


def window_hashes(words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, document by document; windows of each document."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = np.maximum(sizes - window + 1, 0)
    stream = np.fromiter((h for w in words for h in map(_hash_of.__getitem__, w)), np.uint64, int(sizes.sum()))
    if not n.sum():
        return np.empty(0, np.uint64), n
    rolled = np.zeros(len(stream) - window + 1, np.uint64)
    for k in range(window):
        rolled *= BASE
        rolled += stream[k : k + len(rolled)]
    first = np.cumsum(sizes) - sizes
    return rolled[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def smallest(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window, the smallest id that has its hash."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]])) if len(order) else np.empty(0, np.int64)
    out = np.empty(len(ids), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
    return out


class _Bucket:
    """The windows of a bucket's documents, in an order that does not depend on how the rows arrive."""

    def __init__(self, rows: pa.Table, text: str, window: int, parts: int) -> None:
        texts, keys = rows.column(text).to_pylist(), rows.column("_key").to_pylist()
        self.ids = rows.column("_id").fill_null(LAST_ID).to_numpy().astype(np.int64)
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i], self.ids[i], texts[i] or ""))
        self.ids = self.ids[self.order]
        self.words = [(texts[i] or "").encode().split() for i in self.order]
        self.hashes, self.n = window_hashes(self.words, window)
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        own = self.ids[self.of]
        self.flags = own > smallest(self.hashes, own)
        ask = np.flatnonzero(~self.flags)
        part = (self.hashes[ask] >> np.uint64(20)) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        self.ask = ask[by]
        self.parts, first = np.unique(part[by], return_index=True)
        self.cuts = np.append(first, len(by))


def dedup_substrings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, removed (maximal intervals of word positions) and kept_text (the words left, joined by blanks).

    A word goes if a window over it, of `window` words, also starts in a document with a smaller id; what is left plays
    no part in that. Words are runs of characters outside U+0020 and U+0009 to U+000D, unchanged. A null text has no
    words; a null id counts as larger than all others; rows with equal ids do not remove from each other. Columns of docs
    with the names of the results are replaced, other columns stay. No rows give no rows.
    """
    parts = 2 * n_partitions(docs.sparkSession)
    keep, back = set_aside(docs.drop(*[c for c in docs.columns if c in RESULTS.names]), text, id_col)
    dealt = keep.withColumn("_key", row_key(id_col, text)).withColumn("_id", F.col(id_col).cast("long"))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int")).repartition(parts, "_bucket")

    def ask(rows: pa.Table) -> pa.Table:
        b, bucket = _Bucket(rows, text, window, parts), rows.column("_bucket")[0].as_py()
        out = []
        for p, i, j in zip(b.parts.tolist(), b.cuts[:-1], b.cuts[1:], strict=True):
            which = b.ask[i:j]
            doc, counts = np.unique(b.of[which], return_counts=True)
            out.append((p, bucket, b.ids[doc].tobytes(), counts.astype(np.uint32).tobytes(), b.hashes[which].tobytes()))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["p", "bucket", "ids", "counts", "hashes"])

    def answer(blocks: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in blocks.column("hashes").to_pylist()]
        ids = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.uint32)) for i, n in zip(blocks.column("ids").to_pylist(), blocks.column("counts").to_pylist(), strict=True)]
        all_ids = np.concatenate(ids)
        flags = all_ids > smallest(np.concatenate(hashes), all_ids)
        cuts = np.cumsum([0, *map(len, hashes)])
        bits = [np.packbits(flags[i:j]).tobytes() if flags[i:j].any() else None for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        got = pa.Table.from_arrays([blocks.column("bucket").combine_chunks(), blocks.column("p").combine_chunks(), pa.array(bits, pa.binary())], names=["bucket", "p", "bits"])
        return got.filter(pa.compute.is_valid(got.column("bits")))

    schema, columns = T.StructType([*keep.schema.fields, *RESULTS.fields]), keep.columns

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], schema=_arrow(schema))
        b = _Bucket(rows, text, window, parts)
        bits = dict(zip(answers.column("p").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for p, i, j in zip(b.parts.tolist(), b.cuts[:-1], b.cuts[1:], strict=True):
            if p in bits:
                b.flags[b.ask[i:j]] |= np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(j - i)).astype(bool)
        ends = np.cumsum(b.n)
        out = [(len(w), *_cut(w, b.flags[e - n : e], window)) for w, n, e in zip(b.words, b.n.tolist(), ends.tolist(), strict=True)]
        kept = rows.take(pa.array(b.order)).select(columns)
        types = _arrow(schema)
        results = [pa.array([o[k] for o in out], types.field(name).type) for k, name in enumerate(RESULTS.names)]
        return pa.Table.from_arrays([*[kept.column(c).cast(types.field(i).type) for i, c in enumerate(columns)], *results], schema=types)

    # Both passes take all columns, so that the second reads the first's shuffle again.
    flags = dealt.groupBy("_bucket").applyInArrow(ask, BLOCKS).repartition(parts, "p").groupBy("p").applyInArrow(answer, FLAGS)
    return back(dealt.groupBy("_bucket").cogroup(flags.groupBy("bucket")).applyInArrow(cut, schema), *RESULTS.names)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _cut(words: list[bytes], flags: np.ndarray, window: int) -> tuple[int, list[dict], str]:
    """Words removed, the maximal intervals, what is left."""
    starts = np.flatnonzero(flags)
    if not len(starts):
        return 0, [], b" ".join(words).decode()
    new = np.concatenate([[True], starts[1:] > starts[:-1] + window])
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + window
    left, at = [], 0
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        left += words[at:i]
        at = j
    left += words[at:]
    return int((last - first).sum()), [{"start": i, "stop": j} for i, j in zip(first.tolist(), last.tolist(), strict=True)], b" ".join(left).decode()
