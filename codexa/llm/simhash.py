"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a point in the middle: every fingerprint emits all its variants within half the
radius, these are shuffled, and fingerprints that meet on a variant are linked. With a radius of 3 the half is 1:

1. On whole fingerprints, the 65 variants within one bit meet for all pairs at up to 2 bits. All that meet on one variant
   are within 2 bits of each other, so each is linked with the smallest alone; a variant has at most 65 of them.
2. Pairs at exactly 3 bits differ in at most one bit in one of their two halves. Each half emits its 33 variants within
   one bit to meet the other fingerprints' halves; what collides is verified on all 64 bits. Pairs that step 1 has joined
   already are left out.
3. Halves that over HEAVY fingerprints share are not paired. Their fingerprints, if step 1 has put them into different
   components, meet on whole fingerprints at one and two bits (at most 2081 on a variant), which loses no link.

Exact copies share a fingerprint and take part as one. Links are contracted to components by alternating star steps.

With several seeds a text has as many fingerprints, and rows are linked if any pair of fingerprints of one seed is; each
seed's round starts from the components of those before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, hot_safe_join, n_partitions, release, slices, written

WORDS = 3
SEED = 42
RADIUS = 3
#: A half of a fingerprint that more fingerprints share is left to step 3.
HEAVY = 1024
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED, distinct: bool = False) -> int:
    """The 64-bit fingerprint, as a signed integer: a bit is 1 if set in over half the hashes of the shingles (each once, if distinct)."""
    return _fingerprints(text, words, (seed,), distinct)[0]


def _fingerprints(text: str | None, words: int, seeds: tuple[int, ...], distinct: bool) -> list[int]:
    w = (text or "").encode().lower().split()
    if not w:
        return [0] * len(seeds)
    if words == 1:
        shingles = w
    elif len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        stream = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w]).tolist()
        shingles = [stream[i : j - 1] for i, j in zip([0, *ends], ends[words - 1 :], strict=False)]
    if distinct:
        shingles = [*dict.fromkeys(shingles)]
    out, digest = [], xxhash.xxh64_intdigest
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), _BLOCK):
            part = shingles[at : at + _BLOCK]
            h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, seeds: tuple[int, ...] = (SEED,), distinct: bool = False) -> DataFrame:
    """id and fp0, fp1, ... (64 bits as a signed long, one a seed) of each row; a null or wordless text has 0."""
    names = ["id", *(f"fp{k}" for k in range(len(seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            fps = np.array([_fingerprints(t, words, seeds, distinct) for t in b.column(text).to_pylist()], np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(seeds)))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _bits(width: int, most: int) -> str:
    """SQL for an array of all masks with up to `most` (1 or 2) of the low `width` bits."""
    one = f"transform(sequence(0, {width - 1}), i -> shiftleft(1L, i))"
    two = f"flatten(transform(sequence(0, {width - 2}), i -> transform(sequence(i + 1, {width - 1}), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    return f"concat(array(0L), {one}{', ' + two if most == 2 else ''})"


def _half(which: int, fp: str = "fp") -> Column:
    return F.expr(f"{fp} & 4294967295L") if which == 0 else F.expr(f"shiftrightunsigned({fp}, 32)")


def _links(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def near_links(members: DataFrame) -> DataFrame:
    """Step 1: links (u, v) between components of members (fp, each once; comp) that join all fingerprints up to 2 bits apart."""
    spread = members.repartition(n_partitions(members.sparkSession), F.xxhash64("fp"))
    balls = spread.select("comp", F.explode(F.expr(_bits(64, 1))).alias("m"), "fp").select("comp", F.expr("fp ^ m").alias("variant"))
    met = balls.groupBy("variant").agg(F.collect_set("comp").alias("comps")).where("size(comps) > 1").withColumn("u", F.array_min("comps"))
    return met.select("u", F.explode("comps").alias("v")).where("u <> v").distinct()


def far_links(members: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Steps 2 and 3: links (u, v) between components of members (fp, comp) that hold fingerprints exactly 3 bits apart."""
    halves = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), _half(h).alias("v")) for h in (0, 1)])).alias("x")
    members = members.repartition(n_partitions(members.sparkSession), F.xxhash64("fp"))
    index = members.select("fp", "comp", halves).select("fp", "comp", "x.h", "x.v").withColumn("key", F.expr("v | shiftleft(cast(h AS long), 32)"))
    counts = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "halves")
    crowded = counts.where(F.col("rows") > heavy).select("key", F.lit(True).alias("crowded"))
    has = counts.where(F.col("rows") > heavy).limit(1).count() > 0
    light = hot_safe_join(index, crowded, "key", counts).where("crowded IS NULL").drop("crowded") if has else index
    probe = index.select(F.col("fp").alias("fp2"), F.col("comp").alias("comp2"), "h", "v", F.explode(F.expr(_bits(32, 1))).alias("m"))
    probe = probe.select("fp2", "comp2", F.expr("(v ^ m) | shiftleft(cast(h AS long), 32)").alias("key"))
    apart = (F.col("comp") != F.col("comp2")) & (F.expr("bit_count(fp ^ fp2)") <= RADIUS)
    # Spark sizes what explode gives by its input, so it would broadcast the probes of a few hundred thousand fingerprints.
    links = light.hint("merge").join(probe.hint("merge"), (light.key == probe.key) & apart).select(*_links("comp", "comp2"))
    if has:
        rest = hot_safe_join(index, crowded, "key", counts).where("crowded").select("fp", "comp").distinct()
        balls = rest.select("fp", "comp", F.explode(F.expr(_bits(64, 2))).alias("m")).select("comp", F.expr("fp ^ m").alias("variant"), F.expr("bit_count(m)").alias("r"))
        met = balls.groupBy("variant").agg(F.min(F.when(F.col("r") < 2, F.col("comp"))).alias("a"), F.collect_set("comp").alias("comps")).where("a IS NOT NULL AND size(comps) > 1")
        links = links.unionByName(met.select("a", F.explode("comps").alias("b")).where("a <> b").select(*_links("a", "b")))
    return links.distinct()


def _signature(links: DataFrame) -> tuple[int, int | None]:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and comp, the smallest node it can reach, of each node of links (u < v, each once).

    Alternates large-star and small-star steps (Kiveris and others, "Connected components in MapReduce and beyond",
    2014) until every node hangs at its smallest; each step's links are written, so the plan stays short.
    """
    links = links if getattr(links, "_scratch", None) else written(links, "links")
    n, code = _signature(links)
    for _ in range(most if n else 0):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("rows")).withColumn("low", F.least("u", "low")), "lows")
        large = hot_safe_join(both, low.select("u", "low"), "u", low.select("u", "rows"), total=2 * n).where("v > u").select(F.col("low").alias("u"), "v").where("u <> v").distinct()
        large = written(large, "links")
        down = large.select(F.col("v").alias("n"), F.col("u").alias("m"))  # towards smaller neighbours
        lowest = down.groupBy("n").agg(F.min("m").alias("low"))
        small = written(down.join(lowest, "n").select("low", F.explode(F.array("n", "m")).alias("v")).where("low <> v").select(F.col("low").alias("u"), "v").distinct(), "links")
        discard(links, low, large)
        links, before = small, (n, code)
        n, code = _signature(links)
        if (n, code) == before:
            break
    else:
        if n:
            raise RuntimeError(f"components have not settled in {most} steps")
    found = links.select(F.col("v").alias("node"), F.col("u").alias("comp"))
    found._scratch = links._scratch
    return found


def _moved(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with comp replaced by the component that links join it to."""
    found = components(links)
    if found.limit(1).count() == 0:
        return members
    counts = written(members.groupBy("comp").agg(F.count(F.lit(1)).alias("rows")), "counts")
    out = hot_safe_join(members, found.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", counts)
    moved = written(out.withColumn("comp", F.coalesce("_to", "comp")).select(members.columns), "members")
    discard(members, counts, found)
    return moved


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, seeds: tuple[int, ...] = (SEED,), distinct: bool = False, heavy: int = HEAVY) -> DataFrame:
    """id, fp (of the first seed) and component_id (the smallest id reachable by links, itself included) of each row.

    Fingerprints up to 3 bits apart are linked. Null and wordless texts have the fingerprint 0 and are linked like any
    other; rows with a null id take part and get their component's smallest id, or null if there is none; repeated rows
    come out repeated; no rows give no rows. Other columns play no part.
    """
    fps = [f"fp{k}" for k in range(len(seeds))]
    rows = written(fingerprints(docs, id_col, text, words, seeds, distinct), "fingerprints")
    each = written(rows.groupBy("fp0").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least")), "each")
    members = written(rows.select(*fps).distinct().withColumn("comp", F.col("fp0")), "members") if fps[1:] else written(each.select("fp0", F.col("fp0").alias("comp")), "members")
    for k, fp in enumerate(fps):
        own = members.select(F.col(fp).alias("fp"), "comp").distinct()
        least = own.groupBy("fp").agg(F.min("comp").alias("comp"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("rows"))
        if k:  # one fingerprint of this seed in several components
            least = written(least, "least")
            several = least.where("comp <> most").select("fp", F.col("comp").alias("u"), "rows")
            alike = hot_safe_join(own, several.select("fp", "u"), "fp", several.select("fp", "rows")).where("u <> comp").select("u", F.col("comp").alias("v"))
            members = _moved(members, alike.unionByName(near_links(least.select("fp", "comp"))).distinct())
            discard(least)
        else:
            members = _moved(members, near_links(least.select("fp", "comp")))
        members = _moved(members, far_links(members.select(F.col(fp).alias("fp"), "comp").distinct(), heavy))
        if fps[1:]:
            release(docs.sparkSession)
    joined = members.select("fp0", "comp").distinct().join(each, "fp0")
    joined = written(joined, "joined")
    firsts = written(joined.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows")), "firsts")
    named = hot_safe_join(joined.select("fp0", "comp"), firsts.select("comp", "component_id"), "comp", firsts.select("comp", "rows")).select("fp0", "component_id")
    return hot_safe_join(rows, named, "fp0", each.select("fp0", "rows")).select("id", F.col("fp0").alias("fp"), "component_id")
