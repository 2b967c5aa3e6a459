"""Near duplicates by the overlap (Jaccard) of sets of word shingles: SimHash balls and bands of minima propose pairs, each is
verified exactly.

The components of the SimHash operator are proposed first, each text with one of its component. Two 64-bit fingerprints at
an overlap of 0.8 are about 10 bits apart, too far to meet in the middle, so bands propose the rest: each seed gives BANDS
bands of ROWS minima over random orders of a text's shingles; a pair whose overlap is just 0.8 shares none of four seeds'
bands in 3 cases of a million. Only verified pairs are linked.

Texts with equal sets take part as one. In ROUNDS rounds all texts of a band are compared with one of them, first with the
one that most bands hold in common, so a large group of near copies is linked by about as many comparisons as it has texts.

Texts of a band that are in different components after that are joined exactly by prefixes: shingles are put in one order,
the rarer ones first, and two sets can overlap by 0.8 only if they have a shingle in common among the first fifth of each,
at places that leave enough shingles behind. What a text has for itself comes first, so one that has too much of that meets
no other, however large its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm import simhash
from codexa.llm.common import discard, hot_safe_join, release, row_key, slices, written

WORDS = 5
#: The least overlap, as a fraction: verified in integers.
LEAST = (4, 5)
BANDS, ROWS, ROUNDS = 6, 4, 2
#: Counters that order shingles by how frequent they are, and those of one row when they are summed.
COUNTERS, COUNTERS_A_ROW = 1 << 20, 1 << 14
_BLOCK = 1 << 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle, a wordless or null one has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    stream = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    digest = xxhash.xxh64_intdigest
    found = {digest(stream[i : j - 1]) for i, j in zip([0, *ends], ends[min(words, len(w)) - 1 :], strict=False)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _orders(seeds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.concatenate([np.random.default_rng(s).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64) for s in seeds])
    return drawn[:, :1], drawn[:, 1:] | np.uint64(1)


def bands(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of each band of a text with these shingles; none has no bands."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(orders[0]), np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, ((hashes[at : at + _BLOCK] ^ orders[0]) * orders[1]).min(1))
    out = np.arange(1, len(least) // ROWS + 1, dtype=np.uint64) * _FACTOR
    for m in least.reshape(-1, ROWS).T:
        out = (out ^ m) * _FACTOR
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether the sets overlap by the fraction `least` of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= least[0] * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of pairs (u, v) those whose sets are alike."""
    pairs = written(pairs.distinct(), "pairs")
    for own, name in (("u", "left"), ("v", "right")):
        counts = pairs.groupBy(own).agg(F.count(F.lit(1)).alias("rows"))
        named = sets.select(F.col("key").alias(own), F.col("shingles").alias(name))
        joined = hot_safe_join(pairs if own == "u" else joined, named, own, counts, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(b.column("left"), b.column("right"), strict=True)
            yield b.select(["u", "v"]).filter(pa.array([alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in each], pa.bool_()))

    links = written(joined.select("u", "v", "left", "right").mapInArrow(run, "u long, v long"), "verified")
    discard(pairs)
    return links


def _joined(index: DataFrame, links: DataFrame) -> DataFrame:
    """index (key, n, band) with comp, the component that links join its key to."""
    found = simhash.components(links)
    counts = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "counts")
    named = hot_safe_join(index, found.select(F.col("node").alias("key"), "comp"), "key", counts)
    return written(named.withColumn("comp", F.coalesce("comp", "key")), "index")


def _links(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _by_simhash(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of each set with one set of its component by the SimHash operator."""
    found = simhash.near_duplicates(texts, "row", "text", WORDS).select(F.col("id").alias("row"), F.col("component_id").alias("ball")).distinct()
    balls = written(rows.select("row", "key").distinct().join(found, "row").select("key", "ball").distinct(), "balls")
    one = written(balls.groupBy("ball").agg(F.min("key").alias("one"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "ones")
    return hot_safe_join(balls, one.select("ball", "one"), "ball", one.select("ball", "rows"), "inner").where("key <> one").select(*_links("key", "one"))


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _FACTOR >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """About how many sets hold a shingle, by its counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for b in batches:
            for x in b.column("shingles"):
                np.add.at(total, _counter(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        for at in range(0, COUNTERS, COUNTERS_A_ROW):
            which = np.flatnonzero(total[at : at + COUNTERS_A_ROW])
            if len(which):
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "places": pa.array([which.astype(np.uint16).tobytes()], pa.binary()), "counts": pa.array([total[at + which].tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS_A_ROW, np.int64)
        for places, counts in zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
        return pa.table({"at": rows.column("at").slice(0, 1).combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.int64)
    summed = sets.select("shingles").mapInArrow(count, "at int, places binary, counts binary").groupBy("at").applyInArrow(add, "at int, counts binary")
    for r in summed.collect():  # COUNTERS / COUNTERS_A_ROW rows at most
        out[r.at : r.at + COUNTERS_A_ROW] = np.frombuffer(r.counts, np.int64)
    return out


def prefix(hashes: np.ndarray, frequencies: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The shingles of which two sets that are alike have one in common: rarer ones first, ties by hash."""
    ordered = hashes[np.argsort(frequencies[_counter(hashes)], kind="stable")]
    return ordered[: len(hashes) - -(-least[0] * len(hashes) // least[1]) + 1]


def _meeting(held: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of prefixes (shingle, place, key, n, comp, top) that meet on a shingle and can be alike; top: the shingle's largest component."""
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(least[1] / least[0]) * (1 - 1e-9)).cast("int")
    other = held.select("shingle", size.alias("size"), *[F.col(c).alias(f"{c}2") for c in ("place", "key", "n", "comp")])
    one = held.where("comp <> top").withColumn("size", F.explode(F.sequence(size - 1, size + 1)))
    # One of a pair is outside the shingle's largest component, and the shingles behind the common one must suffice.
    can = F.expr(f"comp <> comp2 AND {sum(least)} * least(n - place, n2 - place2) >= {least[0]} * (n + n2)")
    # Spark sizes what explode gives by its input, and would broadcast it.
    return one.hint("merge").join(other.hint("merge"), ["shingle", "size"]).where(can).select(*_links("key", "key2")).distinct()


def _by_prefixes(apart: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of sets (key, n, comp, shingles) in different components that can be alike: no pair that is alike is left out.

    Sets meet on a shingle and a class of sizes, each `least` of the next: those that can be alike are in one class or in
    two that follow each other.
    """
    frequencies = apart.sparkSession.sparkContext.broadcast(_frequencies(apart))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [prefix(np.frombuffer(x.as_buffer(), np.uint64), frequencies.value, least) for x in b.column("shingles")]
            of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            place = np.concatenate([np.arange(len(x)) for x in own]) if own else np.empty(0, np.int64)
            shingle = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(place), *(b.column(c).take(of) for c in ("key", "n", "comp"))], names=["shingle", "place", "key", "n", "comp"])

    first = written(apart.select("key", "n", "comp", "shingles").mapInArrow(run, "shingle long, place long, key long, n long, comp long"), "prefixes")
    each = first.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("rows"))
    several = written(each.groupBy("shingle").agg(F.sum("rows").alias("rows"), F.max_by("comp", "rows").alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1"), "shared")
    held = written(hot_safe_join(first, several.select("shingle", "top"), "shingle", several.select("shingle", "rows"), "inner"), "held")
    pairs = written(_meeting(held, least), "pairs")
    discard(first, several, held)
    return pairs


def link_bands(index: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST, first: DataFrame | None = None, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verified links (u, v) that join all sets of an index (key, n, weight, band, comp) that are alike and share a band.

    sets: (key, shingles); first: pairs to verify beside those of the first round; likely: leaves out pairs that aren't
    worth a verification.
    """
    apart = F.expr(f"comp <> comp2 AND {least[1]} * least(n, n2) >= {least[0]} * greatest(n, n2)")
    links = None
    for k in range(ROUNDS + 1):
        who, by = F.struct("key", "n", "comp"), F.xxhash64("key", F.lit(k))
        one = (F.min_by(who, by) if k else F.max_by(who, F.struct("weight", by))).alias("one")
        several = written(index.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), one, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high"), "several")
        counts = several.select("band", "rows")
        if k < ROUNDS:
            central = several.select("band", F.col("one.key").alias("key2"), F.col("one.n").alias("n2"), F.col("one.comp").alias("comp2"))
            pairs = hot_safe_join(index, central, "band", counts, "inner").where(apart).select(*_links("key", "key2"))
            pairs = pairs.unionByName(first) if k == 0 and first is not None else pairs
        else:
            left = hot_safe_join(index, several.select("band"), "band", counts, "inner").select("key", "n", "comp").distinct()
            left = written(left.join(sets, "key"), "apart")
            pairs = _by_prefixes(left, least)
        found = _verified(likely(pairs) if likely else pairs, sets, least)
        links = found if links is None else written(links.unionByName(found).distinct(), "links")
        if k < ROUNDS:
            index = _joined(index.drop("comp"), links.select("u", "v"))
        discard(several)
        release(index.sparkSession)
    return links.select("u", "v")


def near_duplicates(docs: DataFrame, seeds: tuple[int, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row (its identity by id and text), component_id (the smallest id reachable by links, itself included) and kept.

    Rows are linked if LEAST of their distinct shingles, of both together, are common. Null and wordless texts are linked
    with each other; rows with a null id take part and get their component's smallest id, or null if there is none;
    repeated rows come out repeated; no rows give no rows. Other columns play no part. kept is true for the rows of each
    component whose id is smallest (null comes last), of several texts with that id for those of one.
    """
    orders = _orders(seeds)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            keys = pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64())
            own = pa.array([bands(s, orders) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), keys, pa.array([len(s) for s in sets], pa.int64()), own], names=["id", "row", "key", "n", "bands"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text).alias("row"), F.col(text).alias("text"))
    rows = written(texts.mapInArrow(sketch, "id long, row long, key long, n long, bands array<long>"), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least")
    each = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), least, F.first("n").alias("n"), F.first("bands").alias("bands")), "each")
    index = each.select("key", "n", F.explode("bands").alias("band"))
    met = written(index.groupBy("band").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "bands")
    index = written(hot_safe_join(index, met.select("band", F.log("rows").alias("weight")), "band", met, "inner"), "index")
    weights = index.groupBy("key").agg(F.sum("weight").alias("weight"))
    index = written(index.drop("weight").join(weights, "key").select("key", "n", "weight", "band", F.col("key").alias("comp")), "index")
    balls = written(_by_simhash(texts, rows), "balls")
    asked = index.select("key").union(balls.select("u")).union(balls.select("v")).distinct()
    asked = each.join(asked, "key", "left_semi").select(F.col("least.row").alias("row"), "key")
    sets = written(texts.join(asked, "row").select("key", "text").mapInArrow(full, "key long, shingles binary").dropDuplicates(["key"]), "sets")

    links = link_bands(index, sets, first=balls)
    found = simhash.components(links)
    joined = written(each.select("key", "rows", "least").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key")), "joined")
    firsts = written(joined.groupBy("comp").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("rows")), "firsts")
    named = hot_safe_join(joined.select("key", "comp"), firsts.select("comp", "least"), "comp", firsts.select("comp", "rows")).select("key", "least")
    out = hot_safe_join(rows.select("id", "row", "key"), named, "key", each.select("key", "rows"))
    return out.select("id", "row", F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
