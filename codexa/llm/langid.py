"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds a bitmask of languages in each slot: the masks in the slots of an n-gram, and-ed, give all
languages whose filter contains it. A text's hits are summed for each language, corrected for that filter's rate of false
positives, and the language with the largest share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, row_key, set_aside, slices, written

UNKNOWN = "und"
SIZES = (3, 4)
SLOT_BITS = 21  # three slots from one 64-bit hash
#: Rows the filters are learned from, about, over all languages, and for each at least; masks of a block.
SAMPLE_ROWS, LEAST_ROWS = 5000, 20
BLOCK = 1 << 14
#: An n-gram belongs to a language that has it so often, and at least this share as often as the language that has it most.
MIN_COUNT = 3
MIN_SHARE = 0.35

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass(frozen=True)
class Filters:
    langs: tuple[str, ...]
    masks: np.ndarray  # of each slot; bit i is for langs[i]; over 64 languages: (word, slot), bit i % 64 of word i // 64
    false_rate: np.ndarray


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> np.ndarray:
    """Hashes of the text's n-grams: lower case, everything between letters one blank, one blank at either end."""
    chars = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts, rolled = [], np.zeros(len(chars), np.uint64)
    for k in range(max(SIZES)):
        rolled = rolled[: len(chars) - k] + chars[k:] * _FACTORS[k]
        if k + 1 in SIZES:
            parts.append(rolled * _FACTORS[0])
    h = np.concatenate(parts)
    h ^= h >> np.uint64(29)
    h *= _FACTORS[1]
    h ^= h >> np.uint64(32)
    return h


def _slots(h: np.ndarray) -> list[np.ndarray]:
    most = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * i)) & most).astype(np.int64) for i in range(3)]


def _width(langs: int) -> type:
    return next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if langs <= bits or bits == 64)


def _filters(langs: tuple[str, ...], words: np.ndarray) -> Filters:
    one = words.dtype.type
    filled = np.array([((words[i // 64] >> one(i % 64)) & one(1)).mean() for i in range(len(langs))])
    return Filters(langs, words[0] if len(words) == 1 else words, filled**3)


def fit(samples: list[tuple[str, str]]) -> Filters:
    """Filters from (lang, text) pairs, in memory."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in sorted(samples):
        by.setdefault(lang, []).append(grams(text))
    langs = tuple(sorted(by))
    counts = [np.unique(np.concatenate(by[x]), return_counts=True) for x in langs]
    every, back = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True) if langs else (np.empty(0, np.uint64), np.empty(0, np.int64))
    most, at = np.zeros(len(every)), 0
    for g, n in counts:
        np.maximum.at(most, back[at : at + len(g)], n / n.sum())
        at += len(g)
    width = _width(len(langs))
    words = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), width)
    at = 0
    for i, (g, n) in enumerate(counts):
        own = g[(n >= MIN_COUNT) & (n / n.sum() >= MIN_SHARE * most[back[at : at + len(g)]])]
        at += len(g)
        for s in _slots(own):
            words[i // 64, s] |= width(1 << i % 64)
    return _filters(langs, words)


def identify(model: Filters, text: str | None) -> tuple[str, float]:
    """The language and its share of all corrected hits; ties go to the first in alphabetical order."""
    if not has_letter(text) or not model.langs:
        return UNKNOWN, 0.0
    h = grams(text)
    a, b, c = _slots(h)
    found = model.masks[..., a] & model.masks[..., b] & model.masks[..., c]
    if model.masks.dtype == np.uint8:
        per_mask = np.bincount(found, minlength=256)
        hits = np.array([per_mask[(np.arange(256) >> i & 1) == 1].sum() for i in range(len(model.langs))])
    else:
        words, one = np.atleast_2d(found), found.dtype.type
        hits = np.array([np.count_nonzero(words[i // 64] >> one(i % 64) & one(1)) for i in range(len(model.langs))])
    right = np.maximum(0.0, (hits / len(h) - model.false_rate) / (1 - model.false_rate))
    best = int(right.argmax())
    return model.langs[best], float(right[best] / right.sum()) if right.sum() else 0.0


def learn(rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_ROWS) -> Filters:
    """Filters for all languages, from about `most` of rows, even over languages, drawn by a hash of id and text.

    Whole texts of any length are learned from; rows with equal id and text count once; a null language or text is not
    learned from. Spark counts the n-grams and finds those of each language: what comes to the driver are the filters.
    """
    rows = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    there = rows.groupBy(lang).agg(F.count(F.lit(1))).collect()
    if not there:
        return fit([])
    langs = tuple(sorted(x for x, _ in there))
    share = rows.sparkSession.createDataFrame([(x, langs.index(x), max(LEAST_ROWS, most // len(langs)) / n) for x, n in there], "_of string, _number int, _share double")
    place = F.pmod(F.xxhash64("_row", F.lit("lang")), F.lit(1 << 20)) / (1 << 20)
    named = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("text"), row_key(id_col, text).alias("_row"))
    chosen = named.withColumn("_place", place).join(F.broadcast(share), F.col("_lang") == F.col("_of")).where("_place < _share").dropDuplicates(["_row", "_number"])  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for number, t in zip(b.column("number").to_pylist(), b.column("text").to_pylist(), strict=True):
                found, n = np.unique(grams(t), return_counts=True)
                yield pa.RecordBatch.from_pydict({"number": pa.array(np.full(len(found), number, np.int32)), "gram": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = chosen.select(F.col("_number").alias("number"), "text").mapInArrow(count, "number int, gram long, n long").groupBy("gram", "number").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("number").agg(F.sum("n").alias("total"))
    often = counts.join(F.broadcast(totals), "number").withColumn("share", F.col("n") / F.col("total"))  # a row a language
    own = often.join(often.groupBy("gram").agg(F.max("share").alias("most")), "gram").where((F.col("n") >= MIN_COUNT) & (F.col("share") >= MIN_SHARE * F.col("most")))
    width = _width(len(langs))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((-(-len(langs) // 64), 1 << SLOT_BITS), width)
        for b in batches:
            number = b.column("number").to_numpy()
            bit = np.array([1 << i % 64 for i in range(len(langs))], np.uint64).astype(width)[number]
            for at in _slots(b.column("gram").to_numpy().view(np.uint64)):
                np.bitwise_or.at(words, (number // 64, at), bit)
        blocks = words.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(some.astype(np.int32)), "masks": pa.array([blocks[i].tobytes() for i in some], pa.binary())})

    def merge(rows: pa.Table) -> pa.Table:
        masks = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), width) for x in rows.column("masks")])
        return pa.table({"at": rows.column("at").slice(0, 1).combine_chunks(), "masks": pa.array([masks.tobytes()], pa.binary())})

    words = np.zeros(((-(-len(langs) // 64) << SLOT_BITS) // BLOCK, BLOCK), width)
    filled = own.select("number", "gram").mapInArrow(fill, "at int, masks binary").groupBy("at").applyInArrow(merge, "at int, masks binary")
    for r in filled.collect():  # the filters: 2 ** SLOT_BITS masks for each 64 languages
        words[r["at"]] = np.frombuffer(r["masks"], width)
    discard(counts)
    return _filters(langs, words.reshape(-1, 1 << SLOT_BITS))


def predict(rows: DataFrame, model: Filters, text: str = "text") -> DataFrame:
    """rows with lang_pred and score (0 to 1), which replace columns of these names.

    A null text, one without a letter, and any text where nothing could be learned, is `und` with score 0. Where no n-gram
    is known the first language is given, with score 0. Other columns stay; no rows give no rows.
    """
    from pyspark.sql import types as T

    from codexa.llm.common import with_column

    keep, back = set_aside(rows.drop(*[c for c in ("lang_pred", "score") if c in rows.columns]), text)
    first = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType(), False)])
    schema = T.StructType([*first.fields, T.StructField("score", T.DoubleType(), False)])
    held = rows.sparkSession.sparkContext.broadcast(model)  # 2 ** SLOT_BITS masks of up to 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            got = [identify(held.value, t) for t in b.column(text).to_pylist()]
            out = with_column(b, "lang_pred", pa.array([x for x, _ in got], pa.string()), first)
            yield with_column(out, "score", pa.array([x for _, x in got], pa.float64()), schema)

    return back(keep.mapInArrow(run, schema), "lang_pred", "score")
