"""Quality: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded as surface statistics and a hashed
sketch of its words, put through a learned layer, and weighed by gated attention; the score is that of the weighted
sum. Only document labels are learned from.

Scale: the fit sees a bounded sample (``max_rows`` labelled rows and ``max_bytes`` of their text, chosen by hash) whose texts are encoded where they
are; the encoded bags are fitted in one task. Scoring is one map-side pass with a model of a few kilobytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ASCII_LOWER, SpanHasher, byte_class, map_batches, quoted, slices, utf8, word_spans
from .toxicity import MAX_BYTES, sample_ids, sampled_texts

PASSAGE = 64
SKETCH = 48
MAX_ROWS = 4_000
_CHUNK_BYTES = 1_000_000
_TOKEN = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
#: Fixed: bytes that are counted on their own; the rest falls into lower, upper, digit, non-ASCII and other.
_OWN = b" \n.,;:!?#*%&$|@<>/-_'\"()"
_KINDS = len(_OWN) + 5


def _kinds() -> np.ndarray:
    kind = np.full(256, len(_OWN) + 4, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = len(_OWN), len(_OWN) + 1, len(_OWN) + 2, len(_OWN) + 3
    for i, b in enumerate(_OWN):
        kind[b] = i
    return kind


_KIND = _kinds()
WIDTH = _KINDS + 5 + SKETCH


def passages(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages and their document's row; a document without words has one passage of zeros."""
    n = len(offsets) - 1
    lower = ASCII_LOWER[data]
    start, end, rows = word_spans(lower, offsets, _TOKEN)
    counts = np.diff(rows)
    bags = np.maximum(-(-counts // PASSAGE), 1)
    first = np.cumsum(bags) - bags
    total = int(bags.sum())
    owner = np.repeat(np.arange(n), bags)
    x = np.zeros((total, WIDTH), np.float32)
    if len(start):
        doc = np.repeat(np.arange(n), counts)
        bag = first[doc] + (np.arange(len(start)) - rows[doc]) // PASSAGE
        words = np.maximum(np.bincount(bag, minlength=total), 1)
        # A passage's bytes run from its first word to the next passage's.
        lead = np.flatnonzero(np.diff(bag, prepend=-1))
        until = np.append(start[lead[1:]], len(data))
        until = np.minimum(until, offsets[doc[lead] + 1])
        size = until - start[lead]
        of_byte = np.repeat(bag[lead], size)
        at = np.repeat(start[lead] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kinds = np.bincount(of_byte * _KINDS + _KIND[data[at]], minlength=total * _KINDS).reshape(total, _KINDS)
        x[:, :_KINDS] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
        h = hasher.spans(hasher.prefix(lower), start, end)
        length = (end - start).astype(float)
        mean = np.bincount(bag, length, total) / words
        square = np.bincount(bag, length * length, total) / words
        kept = np.unique((bag.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        repeat = np.zeros(len(h))
        repeat[1:] = (h[1:] == h[:-1]) & (bag[1:] == bag[:-1])
        x[:, _KINDS] = mean / 8
        x[:, _KINDS + 1] = np.sqrt(np.maximum(square - mean * mean, 0)) / 8
        x[:, _KINDS + 2] = np.bincount((kept >> np.uint64(40)).astype(np.int64), minlength=total) / words
        x[:, _KINDS + 3] = np.bincount(bag, repeat, total) / words
        x[:, _KINDS + 4] = np.log1p(words) / np.log1p(PASSAGE)
        slot = (h >> np.uint64(32)).astype(np.int64) % SKETCH
        sign = 1.0 - 2.0 * ((h >> np.uint64(13)) & np.uint64(1))
        x[:, _KINDS + 5 :] = np.bincount(bag * SKETCH + slot, sign, total * SKETCH).reshape(total, SKETCH) / np.sqrt(words)[:, None]
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class AttentionModel:
    """Encoder layer, gated attention and output layer, over standardised passage encodings."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @staticmethod
    def new(mean: np.ndarray, scale: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 7) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        p = {"W": draw(len(mean), hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1)}
        return AttentionModel(mean, scale, p)

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """``start``: where each bag begins; every bag has a passage."""
        p, xs = self.p, (x - self.mean) * self.scale
        h = np.tanh(xs @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["a"]
        size = np.diff(np.append(start, len(x)))
        top = np.repeat(np.maximum.reduceat(e, start), size)
        w = np.exp(e - top)
        w /= np.repeat(np.add.reduceat(w, start), size)
        z = np.add.reduceat(w[:, None] * h, start, axis=0)
        return {"xs": xs, "h": h, "v": v, "u": u, "w": w, "z": z, "size": size, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        dl = (f["y"] - y) / n
        dz = np.repeat(dl[:, None] * p["c"], f["size"], axis=0)
        dw = (dz * f["h"]).sum(axis=1)
        de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, start), f["size"]))
        dv, du = de[:, None] * p["a"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["a"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["w"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["xs"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (de[:, None] * f["v"] * f["u"]).sum(axis=0), "c": f["z"].T @ dl, "d": np.array([dl.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        m, s, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order, lr = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
            for lo in range(0, len(bags), batch):
                pick = order[lo : lo + batch]
                size = np.array([len(bags[i]) for i in pick])
                start = np.cumsum(size) - size
                g = self.gradient(self.forward(np.concatenate([bags[i] for i in pick]), start), labels[pick], start)
                step += 1
                for k, v in g.items():
                    v = v + decay * self.p[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.999 * s[k] + 0.001 * v * v
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> AttentionModel | None:
    """Learn from labelled rows for which ``usable`` holds; None without any.

    The sample is bounded by ``max_rows`` rows and ``max_bytes`` of text (an encoded passage takes about its text's size).

    Labels other than 0 and 1 are left out; of several labels of one doc_id the largest counts, of several rows one.
    """
    ids = sample_ids(labels, label, usable, max_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            bags = []
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                x, owner = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                bags += [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(bags, pa.binary())], ["id", "y", "bag"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "y"])
        bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(float) for b in frame["bag"]]
        every = np.concatenate(bags)
        model = AttentionModel.new(every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 0.02))
        model.fit(bags, frame["y"].to_numpy(float))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    bags = sampled_texts(docs, ids, max_bytes).mapInArrow(encode, "id long, y int, bag binary")
    found = bags.groupBy(F.lit(0).alias("one")).applyInPandas(lambda f: learn(f), "model binary").first()  # a bounded sample in one task
    return pickle.loads(found["model"]) if found else None


def score(docs: DataFrame, model: AttentionModel | None, column: str = "score") -> DataFrame:
    """``docs`` with the score of its whole text (null: empty; 0.5 without a model), replacing ``column``."""
    names = [c for c in docs.columns if c != column]
    at = names.index("text")
    rows = docs.select(*quoted(*names))
    if model is None:
        return rows.withColumn(column, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column(at).cast(pa.string()))
            scores = [np.zeros(0)]
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                x, owner = passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)
                scores.append(model.forward(x, np.searchsorted(owner, np.arange(hi - lo)))["y"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], names=[*names, column])

    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))
