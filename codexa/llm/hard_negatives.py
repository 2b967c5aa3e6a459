"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one component more, sqrt(R^2 - |x|^2) for a row and 0 for an anchor, where R is the largest norm, the distance between
an anchor q and a row x is |q|^2 + R^2 - 2 q.x: rows of the highest scores are the nearest, and a window of scores is an
annulus around the anchor.

1. A vantage-point tree over a sample of LEAF_SAMPLE rows a leaf deals all rows to leaves; each leaf keeps, for the vantage
   points above it, the least and greatest distance of its rows, all of them. A leaf has at most MOST_LEAVES siblings, so
   their bounds fit any machine.
2. A leaf is cut into shards of about SHARD rows, however many rows are alike, and each shard becomes a tree of its own.
3. An anchor first visits its own leaf; what it finds there bounds the distances that can still matter, and it visits the
   other leaves that reach into its annuli. Within a shard it goes from one bucket to the next nearest, by the triangle
   inequality's bound, until no bucket that is left can hold anything nearer than what it has.

Positives come first (the nearest of the same label, in an annulus without bounds), then the annulus of each positive is
searched for rows of other labels. Scores are exact integers; distances only leave out what can't matter, with a margin for
rounding, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.llm.common import free_name, written

#: Rows of a shard, anchors that visit a shard together, rows of a bucket.
SHARD, SLAB, BUCKET = 8192, 4096, 64
MOST_LEAVES, LEAF_SAMPLE = 2048, 32
_NONE = -(1 << 62)
_NO_ID = (1 << 63) - 1
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SHARD = "leaf int, salt int, ids array<long>, labels array<long>, vectors binary, vantage array<int>, low array<double>, high array<double>, cuts array<int>"


class Space(NamedTuple):
    """What all distances share: components of a vector and the largest squared norm."""

    dim: int
    reach: int

    @property
    def margin(self) -> float:
        return 1e-6 * (1 + self.reach**0.5)

    def matrix(self, column) -> np.ndarray:
        """Packed vectors as rows; what a vector lacks in components counts as 0."""
        packed = column.to_pylist()
        if all(len(x) == 4 * self.dim for x in packed):
            return np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), self.dim).astype(np.float64)
        out = np.zeros((len(packed), self.dim))
        for row, x in zip(out, packed, strict=True):
            row[: len(x) // 4] = np.frombuffer(x, np.int32)
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The component that makes all rows as long as the longest."""
        return np.sqrt(np.maximum(0, self.reach - (x * x).sum(1)))

    def between(self, products: np.ndarray) -> np.ndarray:
        """Distances of rows by their augmented products."""
        return np.sqrt(np.maximum(0, 2 * self.reach - 2 * products))

    def around(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances of rows with these scores from anchors with these squared norms."""
        return np.sqrt(np.maximum(0, norms + self.reach - 2.0 * scores))


def scaled(df: DataFrame, id_col: str, vector: str, label: str, by: float) -> DataFrame:
    """id, label and vector (whole numbers: floor(by * x)) of rows whose label and vector, in all components, are known and finite."""
    inf = F.lit(float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    known = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & known).withColumn("vector", F.transform("vector", lambda x: F.floor(x * by)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("vector")
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy().astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(flat * flat)]) if len(flat) else np.zeros(1)
        if sums[-1] >= 1 << 53:
            sums = None
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        norms = [sum(int(x) ** 2 for x in flat[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)] if sums is None else np.diff(sums[cuts]).astype(np.int64).tolist()
        if max(norms, default=0) >= 1 << 53:
            raise ValueError("a vector's squared norm is 2^53 or more: its scores can't be held exactly")
        words = flat.astype(np.int32).tobytes()
        packed = pa.array([words[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"), packed, pa.array(norms, pa.int64())], names=["id", "label", "anchor", "v", "norm"])


class Router(NamedTuple):
    """The tree over the sample: a complete binary tree, node i above nodes 2i + 1 (inside its radius) and 2i + 2."""

    depth: int
    points: np.ndarray
    lifts: np.ndarray
    radius: np.ndarray

    def route(self, space: Space, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances from the vantage points above."""
        node, path, lift = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth)), space.lift(x)
        for level in range(self.depth):
            path[:, level] = space.between((x * self.points[node]).sum(1) + lift * self.lifts[node])
            node = 2 * node + 1 + (path[:, level] > self.radius[node])
        return (node - (1 << self.depth) + 1).astype(np.int32), path


def fit_router(space: Space, sample: np.ndarray, depth: int) -> Router:
    rng = np.random.default_rng(11)
    lift = space.lift(sample)
    nodes = (1 << depth) - 1
    points, lifts, radius = np.zeros((nodes, space.dim)), np.zeros(nodes), np.full(nodes, np.inf)
    held = {0: np.arange(len(sample))}
    for node in range(nodes):
        own = held.pop(node)
        inside = np.ones(len(own), bool)
        if len(own):
            at = rng.choice(own)
            points[node], lifts[node] = sample[at], lift[at]
            d = space.between(sample[own] @ sample[at] + lift[own] * lift[at])
            radius[node] = np.median(d)
            inside = d <= radius[node]
        held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return Router(depth, points, lifts, radius)


def build_tree(space: Space, x: np.ndarray, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A vantage-point tree over rows: their order, by buckets; the nodes' vantage points (places in that order), their two
    children's least and greatest distances; the buckets' cuts. Children are halves, so rows that are alike cost no depth."""
    n, lift = len(x), space.lift(x)
    depth = max(0, int(np.ceil(np.log2(max(1, n / max(bucket, 2))))))
    order, cuts, vantage, low, high = np.arange(n), [0, n], [], [], []
    for _ in range(depth):
        halves = [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own, mid = order[a:b], (a + b) // 2
            far = own[np.argmin(x[own] @ x[own[0]] + lift[own] * lift[own[0]])]
            d = space.between(x[own] @ x[far] + lift[own] * lift[far])
            by = np.argsort(d, kind="stable")
            order[a:b], d = own[by], d[by]
            vantage.append(far)
            low += [d[0], d[mid - a]]
            high += [d[mid - a - 1], d[-1]]
            halves += [mid, b]
        cuts = halves
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[np.array(vantage, np.int64)], np.array(low), np.array(high), np.array(cuts)


def _bounds(away: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distances of anchors from the rows of each bucket, by their distances from the nodes' vantage points."""
    near, far = np.zeros((len(away), 1)), np.full((len(away), 1), np.inf)
    for level in range(depth):
        first, n = (1 << level) - 1, 1 << level
        d = np.repeat(away[:, first : first + n], 2, axis=1)
        lo, hi = low[2 * first : 2 * (first + n)], high[2 * first : 2 * (first + n)]
        near = np.maximum(np.repeat(near, 2, axis=1), np.maximum(d - hi, lo - d))
        far = np.minimum(np.repeat(far, 2, axis=1), d + hi)
    return near, far


class Asks(NamedTuple):
    """Anchors and their windows: scores from low to high, of these the best; cut is the score that is known to be among them."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cut: np.ndarray


def search(space: Space, tree: tuple, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, asks: Asks, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """For each ask and window the k best ids and scores (ties by smaller id; unused places have the score _NONE) of rows
    whose label is the anchor's (same) or isn't, and how many scores were computed.

    Buckets are visited nearest first: the r-th step takes each ask to its r-th nearest bucket, all asks of a bucket at once.
    """
    vantage, low, high, cuts = tree
    depth = (len(cuts) - 1).bit_length() - 1
    near, far = _bounds(space.around(asks.norms[:, None], asks.x @ x[vantage].T), low, high, depth)
    order = np.argsort(near, axis=1, kind="stable")
    n, w = asks.low.shape
    best_ids, best = np.full((n, w, k), _NO_ID), np.full((n, w, k), _NONE)
    floor, inner = np.maximum(asks.low, asks.cut), space.around(asks.norms[:, None], asks.high)
    each, computed = np.arange(n), 0
    for r in range(order.shape[1]):
        bucket = order[:, r]
        outer = space.around(asks.norms[:, None], np.maximum(floor, best[:, :, -1])) + space.margin
        lo, hi = near[each, bucket][:, None], far[each, bucket][:, None]
        if not (lo <= outer).any():
            break
        useful = (asks.low <= asks.high) & (lo <= outer) & (hi >= inner - space.margin)
        going = np.flatnonzero(useful.any(1))
        for b in np.unique(bucket[going]):
            own, rows = going[bucket[going] == b], slice(cuts[b], cuts[b + 1])
            scores = np.rint(asks.x[own] @ x[rows].T).astype(np.int64)
            computed += scores.size
            fits = ((asks.labels[own, None] == labels[rows]) == same) & (asks.ids[own, None] != ids[rows])
            for i in range(w):
                ok = fits & (scores >= np.maximum(floor[own, i], best[own, i, -1])[:, None]) & (scores <= asks.high[own, i, None])
                hit = np.flatnonzero(ok.any(1))
                if len(hit):
                    s = np.concatenate([best[own[hit], i], np.where(ok[hit], scores[hit], _NONE)], axis=1)
                    t = np.concatenate([best_ids[own[hit], i], np.where(ok[hit], ids[rows], _NO_ID)], axis=1)
                    top = np.lexsort((t, -s), axis=-1)[:, :k]
                    best[own[hit], i], best_ids[own[hit], i] = np.take_along_axis(s, top, 1), np.take_along_axis(t, top, 1)
    return best_ids, best, computed


def _whole(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _lists(column, missing: int) -> np.ndarray:
    return np.array([[missing if v is None else v for v in x] for x in column.to_pylist()], np.int64)


class Index(NamedTuple):
    """The rows as shards of trees, and the leaves they are of: salts (shards), bounds of distances from the points above."""

    space: Space
    router: Router
    routed: DataFrame
    shards: DataFrame
    leaves: DataFrame
    low: np.ndarray
    high: np.ndarray
    slabs: int


def build_index(rows: DataFrame, space: Space, n: int, slabs: int, shard: int = SHARD, bucket: int = BUCKET) -> Index:
    """The index of packed rows (id, label, v, norm, and others that stay in `routed`); n: their number. Every row is in it."""
    spark = rows.sparkSession
    depth = min(MOST_LEAVES.bit_length() - 1, max(0, (n // shard).bit_length() - 1))
    wanted = LEAF_SAMPLE << depth  # MOST_LEAVES * LEAF_SAMPLE rows, about, at most
    drawn = rows.where(F.pmod(F.xxhash64("v", "id"), F.lit(1 << 30)) < int(min(1.0, wanted / max(n, 1)) * (1 << 30))).select("v")
    sample = space.matrix(drawn.toArrow().column("v")) if depth else np.zeros((0, space.dim))
    router = fit_router(space, sample[np.lexsort(sample.T)] if len(sample) and space.dim else sample, depth)
    shared = spark.sparkContext.broadcast((space, router))  # MOST_LEAVES vectors at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, by = shared.value
        for b in batches:
            leaf, path = by.route(where, where.matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(list(path), pa.list_(pa.float64()))], names=[*b.schema.names, "leaf", "path"])

    routed = written(rows.mapInArrow(route, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, leaf int, path array<double>"), "routed")
    sides = [f(F.col("path")[j]).alias(f"{name}{j}") for j in range(depth) for f, name in ((F.min, "low"), (F.max, "high"))]
    held = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *sides).collect()  # MOST_LEAVES rows at most
    low, high = np.full((1 << depth, depth), np.inf), np.full((1 << depth, depth), -np.inf)
    for r in held:
        low[r.leaf], high[r.leaf] = [r[f"low{j}"] for j in range(depth)], [r[f"high{j}"] for j in range(depth)]
    leaves = spark.createDataFrame([(r.leaf, -(-r.rows // shard)) for r in held], "leaf int, salts int")

    def build(rows: pa.Table) -> pa.Table:
        where, _ = shared.value
        x = where.matrix(rows.column("v"))
        order, vantage, lo, hi, cuts = build_tree(where, x, bucket)
        row = {
            "leaf": [rows.column("leaf")[0].as_py()], "salt": [rows.column("salt")[0].as_py()], "ids": [rows.column("id").take(pa.array(order)).to_pylist()], "labels": [_whole(rows.column("label"))[order]],
            "vectors": [x[order].astype(np.int32).tobytes()], "vantage": [vantage.astype(np.int32)], "low": [lo], "high": [hi], "cuts": [cuts.astype(np.int32)],
        }
        kinds = {"leaf": pa.int32(), "salt": pa.int32(), "vectors": pa.binary(), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "vantage": pa.list_(pa.int32()), "cuts": pa.list_(pa.int32()), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in row.items()})

    salted = routed.join(F.broadcast(leaves), "leaf").withColumn("salt", F.pmod(F.xxhash64("id", "label", "v"), F.col("salts")).cast("int"))
    shards = written(salted.select("leaf", "salt", "id", "label", "v").groupBy("leaf", "salt").applyInArrow(build, _SHARD), "shards")
    return Index(space, router, routed, shards, leaves, low, high, slabs)


def _visit(asks: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """The k best (key, slot, id, score) that each shard of the asks' leaves holds."""
    space, slabs = index.space, index.slabs

    def run(asks: pa.Table, shards: pa.Table) -> pa.Table:
        names = ("key", "slot", "id", "score")
        if not asks.num_rows or not shards.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        s = {c: shards.column(c)[0] for c in shards.schema.names}
        value = lambda c: s[c].values.to_numpy(zero_copy_only=False)
        ids = np.array([_NO_ID if v is None else v for v in s["ids"].as_py()], np.int64)
        x = np.frombuffer(s["vectors"].as_buffer(), np.int32).reshape(len(ids), space.dim).astype(np.float64)
        tree = value("vantage"), value("low"), value("high"), value("cuts")
        own = Asks(_whole(asks.column("id")), _whole(asks.column("label")), space.matrix(asks.column("v")), _whole(asks.column("norm")).astype(np.float64), *(_lists(asks.column(c), _NONE) for c in ("low", "high", "cut")))
        found, scores, _ = search(space, tree, ids, value("labels"), x, own, k, same)
        row, slot, place = np.nonzero(scores > _NONE)
        other = found[row, slot, place]
        return pa.table([pa.array(_whole(asks.column("key"))[row]), pa.array(slot.astype(np.int64)), pa.array(other, mask=other == _NO_ID), pa.array(scores[row, slot, place])], names=names)

    spread = asks.join(F.broadcast(index.leaves), "leaf").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts").withColumn("slab", F.pmod("key", F.lit(slabs)).cast("int"))
    shards = index.shards.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    by = ("leaf", "salt", "slab")
    return spread.groupBy(*by).cogroup(shards.groupBy(*by)).applyInArrow(run, "key long, slot long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _nearest(asks: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """key, slot, place (from 1), id and score of the k best rows in each ask's windows (low and high, arrays of scores)."""
    columns = ("key", "id", "label", "v", "norm", "leaf", "low", "high")
    first = written(_best(_visit(asks.select(*columns, F.array_repeat(F.lit(_NONE), F.size("low")).alias("cut")), index, k, same), k), "first")
    if not index.router.depth:
        return first
    full = first.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    cuts = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("cuts"))  # an entry a window
    cut = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("cuts", i.cast("long")), F.lit(_NONE)))
    asks = asks.join(cuts, "key", "left").withColumn("cut", cut)
    shared = asks.sparkSession.sparkContext.broadcast((index.space, index.router, index.low, index.high))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, router, low, high = shared.value
        above = [[((1 << level) - 1) + (leaf >> (router.depth - level)) for level in range(router.depth)] for leaf in range(1 << router.depth)]
        for b in batches:
            norms, x = b.column("norm").to_numpy().astype(np.float64)[:, None], space.matrix(b.column("v"))
            away = space.around(norms, x @ router.points.T)
            lo, hi, cut = (_lists(b.column(c), _NONE) for c in ("low", "high", "cut"))
            outer, inner = space.around(norms, np.maximum(lo, cut)) + space.margin, space.around(norms, hi) - space.margin
            going = []
            for leaf, nodes in enumerate(above):
                d = away[:, nodes]
                near, far = np.maximum(d - high[leaf], low[leaf] - d).max(1)[:, None], (d + high[leaf]).min(1)[:, None]
                going.append(((lo <= hi) & (near <= outer) & (far >= inner)).any(1))
            leaf, row = np.nonzero(np.array(going))
            other = leaf != b.column("leaf").to_numpy()[row]
            leaf, row = leaf[other], pa.array(row[other])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in b.schema.names if c != "leaf"), pa.array(leaf.astype(np.int32))], names=[*(c for c in b.schema.names if c != "leaf"), "leaf"])

    far = asks.select(*[c for c in columns if c != "leaf"], "cut", "leaf").mapInArrow(reach, "key long, id long, label long, v binary, norm long, low array<long>, high array<long>, cut array<long>, leaf int")
    return _best(first.drop("place").unionByName(_visit(far, index, k, same)), k)


def _floor_div(x: Column, by: int) -> Column:
    """floor(x / by) of whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard: int = SHARD, slab: int = SLAB, bucket: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of rows (id, label, vector of whole numbers).

    Anchors are the rows where `anchor` holds. An anchor's positives are the `positives` rows of its label with the highest
    inner products; a positive's negatives the first `negatives` rows of other labels with low to high percent of its score.
    Ties go to the smaller id.

    Rows without a label or vector take no part. A row's identity is its id, label and vector: equal rows count once, rows
    that only share an id are told apart, but none is another's positive or negative. A null id comes last among ties and is
    no anchor's; an anchor without an id is none. Vectors of different lengths are filled up with 0, an empty one is all 0.
    A squared norm of 2^53 or more raises ValueError. No rows give no rows; other columns play no part.
    """
    spark = rows.sparkSession
    name = free_name(rows, "_anchor")
    known = rows.withColumn(name, F.coalesce(anchor, F.lit(False)) & F.col("id").isNotNull()).where("label IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"), F.col(name).alias("anchor"))
    packed = written(known.mapInArrow(_pack, "id long, label long, anchor boolean, v binary, norm long").dropDuplicates(["id", "label", "v"]), "vectors")
    n, reach, size, n_anchors = packed.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.length("v")), F.count_if("anchor")).first()
    if not n_anchors:
        return spark.createDataFrame([], _RESULT)
    space = Space(size // 4, reach)
    index = build_index(packed, space, n, -(-n_anchors // slab), shard, bucket)
    anchors = index.routed.where("anchor").select(F.xxhash64("id", "label", "v").alias("key"), "id", "label", "v", "norm", "leaf")
    wide = [F.array(F.lit(x)).cast("array<long>").alias(c) for c, x in (("low", _NONE), ("high", -_NONE))]
    near = _nearest(anchors.select("*", *wide), index, positives, True)
    near = written(near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).cast("long").alias("slot")), "positives")
    scores = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("scores"))  # `positives` entries
    lowest = F.transform("scores", lambda s: -_floor_div(-low * s["positive_score"], 100)).alias("low")
    highest = F.transform("scores", lambda s: _floor_div(high * s["positive_score"], 100)).alias("high")
    asks = anchors.join(scores, "key").select(*anchors.columns, lowest, highest)
    far = _nearest(asks, index, negatives, False)
    named = far.select("key", "slot", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = named.join(near, ["key", "slot"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
