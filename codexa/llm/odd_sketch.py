"""MinHash near-dedup with odd sketches: bands of minima propose pairs, parity bitmaps estimate their similarity, full sets confirm.

A text's set are its distinct shingles. SAMPLES minima over random orders of the set are its MinHash sample; BANDS bands of
ROWS minima each propose candidates. The sample is also folded into a bitmap of BITS bits, each minimum with its number
turning one bit over (Mitzenmacher, Pagh and Pham, "Efficient estimation for high similarities using odd sketches", 2014).
The exclusive or of two bitmaps is the bitmap of what differs between the samples, so its population count tells how many
minima differ, and the more precisely the fewer do. A candidate whose estimate is DEVIATIONS standard deviations below the
bound is left out; all others are confirmed on their full sets.

A pair just at the bound shares none of the bands in 1 case of 10^8, and its estimate leaves it out in 1 of 10^9. Texts with
equal sets take part as one; how large groups are linked is told in `overlap`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm import simhash
from codexa.llm.common import hot_safe_join, slices, written
from codexa.llm.overlap import WORDS, link_bands, shingles

#: The least similarity that links, as a fraction: confirmed in integers.
LEAST = (17, 20)
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
BITS = 512
DEVIATIONS = 6
SEED = 12
_BLOCK = 1 << 11
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NUMBERS = np.arange(1, SAMPLES + 1, dtype=np.uint64) * _FACTOR
_XOR, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SAMPLES, 1), np.uint64)
_TIMES = _TIMES | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FACTOR
    return x ^ (x >> np.uint64(29))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes in each of SAMPLES random orders; of an empty set the largest number."""
    least = np.full(SAMPLES, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, ((hashes[at : at + _BLOCK] ^ _XOR) * _TIMES).min(1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of each band of minima."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTOR
    for m in least.reshape(BANDS, ROWS).T:
        out = _mixed(out ^ m)
    return out.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap of a sample, as bytes: a bit is set if an odd number of minima falls on it."""
    counts = np.bincount((_mixed(_mixed(least) ^ _NUMBERS) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def estimate(ones: float) -> float:
    """The similarity of two sets whose sketches differ in so many bits."""
    return 1 + BITS / (4 * SAMPLES) * math.log(1 - 2 * ones / BITS) if 2 * ones < BITS else 0.0


def most_ones(least: tuple[int, int] = LEAST) -> int:
    """The bits in which two sketches may differ for their pair to be confirmed: those of an estimate DEVIATIONS below `least`."""
    at = least[0] / least[1]
    turned = 2 * SAMPLES * (1 - at)  # minima that differ turn a bit over in each of the sketches
    p = (1 - math.exp(-2 * turned / BITS)) / 2
    of_bits = math.sqrt(BITS * p * (1 - p)) / (1 - 2 * p) / (2 * SAMPLES)
    cut = at - DEVIATIONS * math.hypot(math.sqrt(at * (1 - at) / SAMPLES), of_bits)
    return max(z for z in range(BITS // 2) if estimate(z) >= cut)


def likely_pairs(pairs: DataFrame, sketches: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Of pairs (u, v) those whose sketches (key, odd) let them be alike."""
    pairs = joined = written(pairs.distinct(), "candidates")
    for own, name in (("u", "left"), ("v", "right")):
        counts = pairs.groupBy(own).agg(F.count(F.lit(1)).alias("rows"))
        joined = hot_safe_join(joined, sketches.select(F.col("key").alias(own), F.col("odd").alias(name)), own, counts, "inner")
    words = range(BITS // 64)
    ones = sum((F.bit_count(F.col("left")[i].bitwiseXOR(F.col("right")[i])) for i in words), F.lit(0))
    return joined.where(ones <= most_ones(least)).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """id, n (the size of the set), component_id (the smallest id reachable by links, itself included) and kept of each row.

    A set has the distinct shingles of five words, A-Z in lower case; a text of fewer words is one shingle. Rows are linked
    if `least` of the shingles of both together are common. Null, empty and wordless texts have no set and are linked with
    nothing: each is its own component. Rows with a null id take part; they get their component's smallest id, or null if
    there is none. Repeated rows come out repeated. kept is true where id is component_id, for a null id where no row of
    its component has one. No rows give no rows; other columns, whatever they are called, play no part.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t, WORDS) for t in b.column("text").to_pylist()]
            samples = [minima(s) if len(s) else None for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("hash"), pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bands(m) if m is not None else None for m in samples], longs), pa.array([odd_sketch(m).view(np.int64) if m is not None else None for m in samples], longs),
                ],
                names=["id", "hash", "key", "n", "bands", "odd"],
            )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t, WORDS) for t in b.column("text").to_pylist()]
            keys = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("hash"))
    rows = written(texts.mapInArrow(sketch, "id long, hash long, key long, n long, bands array<long>, odd array<long>"), "minima")
    each = written(rows.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.min("hash").alias("hash"), *[F.first(c).alias(c) for c in ("n", "bands", "odd")]), "each")
    index = each.select("key", "n", F.explode("bands").alias("band"))
    met = written(index.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "bands")
    index = written(hot_safe_join(index, met.select("band", F.log("rows").alias("weight")), "band", met, "inner"), "index")
    weights = index.groupBy("key").agg(F.sum("weight").alias("weight"))
    index = written(index.drop("weight").join(weights, "key").select("key", "n", "weight", "band", F.col("key").alias("comp")), "index")
    asked = each.join(index.select("key").distinct(), "key", "left_semi").select("hash", F.lit(True).alias("asked"))
    copies = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    one_each = hot_safe_join(texts, asked, "hash", copies, "inner").select("hash", "text").dropDuplicates(["hash"])
    sets = written(one_each.mapInArrow(full, "key long, shingles binary"), "sets")

    links = link_bands(index, sets, least, likely=lambda pairs: likely_pairs(pairs, each, least))
    found = simhash.components(links)
    joined = written(each.select("key", "rows", F.col("least").alias("own")).join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key")), "joined")
    firsts = written(joined.groupBy("comp").agg(F.min("own").alias("component_id"), F.count(F.lit(1)).alias("rows")), "firsts")
    named = hot_safe_join(joined.select("key", "comp"), firsts.select("comp", "component_id"), "comp", firsts.select("comp", "rows")).select("key", "component_id")
    own = rows.select("id", "n", "key")
    out = hot_safe_join(own.where("n > 0"), named, "key", each.select("key", "rows")).select("id", "n", "component_id")
    out = out.unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
