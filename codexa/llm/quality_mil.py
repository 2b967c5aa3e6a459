"""Quality classifier by attention-based multiple-instance learning (Ilse and others, 2018).

A text is a bag of passages. Each passage is encoded (a learned layer over its character-class pairs and word shape),
gated attention gives each passage a weight, and the weighted sum of the encoded passages is scored. Only the label of
the whole document is known in training; encoder, attention and score are learned from it together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm.common import row_key, set_aside, slices, with_column

PASSAGE_WORDS = 80
#: Labelled rows learned from, about, drawn by a hash of id and text.
SAMPLE_ROWS = 6000
ACCEPT_FROM = 0.3
CODED, GATE, EPOCHS, BATCH, RATE, SEED = 32, 16, 14, 128, 0.004, 7
#: Few labels are gone through more often, until there have been so many steps.
LEAST_STEPS = 600

_CLASSES = 14


def _class_table() -> np.ndarray:
    table = np.full(256, 13, np.int64)  # other control characters
    table[128:] = 0  # parts of letters beyond ASCII
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 1, 2, 3
    for k, chars in enumerate((" ", ".", ",;:", "!", "?", "|", "#*$%&<>=+~^@\\", "\"'`", "()[]{}-_/"), 4):
        table[[*chars.encode()]] = k
    return table


_CLASS = _class_table()
WIDTH = _CLASSES * _CLASSES + 6


def passages(text: str | None) -> np.ndarray:
    """One row for each PASSAGE_WORDS words: shares of character-class pairs, then word shape; one row of zeros if there is no word."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n = len(words)
    count = -(-n // PASSAGE_WORDS)
    of = np.arange(n) // PASSAGE_WORDS
    sizes = np.fromiter(map(len, words), np.int64, n)
    held = np.bincount(of, minlength=count)
    chars = _CLASS[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
    where = np.repeat(of, sizes + 1)
    pairs = np.bincount(where[:-1] * _CLASSES**2 + chars[:-1] * _CLASSES + chars[1:], minlength=count * _CLASSES**2).reshape(count, -1)
    names = np.fromiter(map(hash, words), np.int64, n)
    order = np.lexsort((names, of))
    first = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (of[order][1:] != of[order][:-1])])
    same = np.concatenate([[False], names[1:] == names[:-1]])
    mean = np.bincount(of, sizes, count) / held
    out = np.empty((count, WIDTH), np.float32)
    out[:, :-6] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
    out[:, -6] = np.bincount(of[order][first], minlength=count) / held
    out[:, -5] = np.bincount(of, same, count) / held
    out[:, -4] = mean / 10
    out[:, -3] = np.bincount(of, np.abs(sizes - mean[of]), count) / held / 10
    out[:, -2] = np.bincount(of, sizes > 16, count) / held
    out[:, -1] = np.log1p(held) / 5
    return out


@dataclass
class Attention:
    """Weights: w, b of the encoder; v, u, a of the gated attention; c, d of the score."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores of the bags that begin at starts in the stacked passages x."""
        p, of = self.weights, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.maximum(0, x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        k = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(k[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return s, {"h": h, "t": t, "g": g, "k": k, "z": z, "of": of}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        s, q = self.forward(x, starts)
        ds = (s - y) / len(y)
        dz = ds[:, None] * p["c"]
        of, h, k = q["of"], q["h"], q["k"]
        dk = (dz[of] * h).sum(1)
        de = k * (dk - np.add.reduceat(k * dk, starts)[of])
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * q["g"] * (1 - q["t"] ** 2), dtg * q["t"] * q["g"] * (1 - q["g"])
        dh = (k[:, None] * dz[of] + dt @ p["v"].T + dg @ p["u"].T) * (h > 0)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (q["t"] * q["g"]).T @ de, "c": q["z"].T @ ds, "d": ds.sum(keepdims=True)}

    def score(self, text: str | None) -> float:
        return float(self.forward(passages(text), np.zeros(1, np.int64))[0][0])


def train(bags: list[np.ndarray], labels: np.ndarray) -> Attention | None:
    """Adam over shuffled batches of bags, from a fixed seed; None without labels."""
    if not len(labels):
        return None
    rng, y = np.random.default_rng(SEED), labels.astype(np.float64)
    size = {"w": (WIDTH, CODED), "b": (CODED,), "v": (CODED, GATE), "u": (CODED, GATE), "a": (GATE,), "c": (CODED,), "d": (1,)}
    model = Attention({k: rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) if len(s) > 1 else np.zeros(s) for k, s in size.items()})
    model.weights["c"], model.weights["a"] = rng.normal(0, 0.2, CODED), rng.normal(0, 0.2, GATE)
    first, second, step = {k: np.zeros(s) for k, s in size.items()}, {k: np.zeros(s) for k, s in size.items()}, 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in own]).astype(np.float64)
            starts = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
            step += 1
            for k, g in model.gradient(x, starts, y[own]).items():
                g = g + 1e-5 * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * (1 - epoch / epochs)
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS) -> Attention | None:
    """A model from the rows of docs that labels has a non-null label for: all of them, or about `most`, drawn by a hash.

    Texts of any length take part. Of several labels for an id the smallest counts; null ids have none; rows with equal id
    and text count once; without labelled rows there is no model.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).cast("int").alias("_label"))
    there = docs.select(id_col).join(known, id_col, "left_semi").count()
    place = F.pmod(F.xxhash64("_row", F.lit("quality")), F.lit(1 << 20)) / (1 << 20)
    drawn = docs.select(id_col, text, row_key(id_col, text).alias("_row")).where(place < most / max(most, there))
    rows = drawn.join(known, id_col).dropDuplicates(["_row"]).select(id_col, text, "_label")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            coded = [passages(t).tobytes() for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), b.column("_label"), pa.array(coded, pa.binary())], names=["id", "label", "coded"])

    got = sorted((r.id, bytes(r.coded), r.label) for r in rows.mapInArrow(encoded, "id long, label int, coded binary").collect())  # about `most` rows
    return train([np.frombuffer(c, np.float32).reshape(-1, WIDTH) for _, c, _ in got], np.array([x for _, _, x in got]))


def score(docs: DataFrame, model: Attention | None, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (higher: better quality likelier), which replaces a column of that name.

    A null or wordless text is scored as one empty passage. Without a model all scores are 0.5. Other columns stay; equal
    texts have equal scores; no rows give no rows.
    """
    keep, back = set_aside(docs.drop(column), text)
    schema = T.StructType([*keep.schema.fields, T.StructField(column, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            got = [0.5 if model is None else model.score(t) for t in b.column(text).to_pylist()]
            yield with_column(b, column, pa.array(got, pa.float64()), schema)

    return back(keep.mapInArrow(run, schema), column)
