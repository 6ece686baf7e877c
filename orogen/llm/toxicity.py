"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Scale: the fit sees a bounded sample (``max_rows`` labelled rows and ``max_bytes`` of their text, chosen by hash), whose features are extracted where
the texts are; FTRL is sequential, so one task runs it, over at most that sample. Features of fewer than ``MIN_DOCS``
sampled documents are left out and L1 leaves few weights of the others, so the model that every task gets is a small
sparse array however large the hash space. Scoring is one map-side pass.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ASCII_LOWER, SpanHasher, lean, map_batches, materialize, mix, quoted, slices, text_or_empty, utf8, word_spans

BITS = 24
MIN_DOCS = 3
MAX_ROWS = 12_000
MAX_BYTES = 96_000_000
_CHUNK_BYTES = 1_000_000
_MASK = (1 << BITS) - 1
#: Words apart of the pairs that are features, besides single words and three words in a row.
_PAIRS = (1, 2, 3)


def features(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature index of every word, word pair (next, and with one or two words skipped) and word triple."""
    lower = ASCII_LOWER[data]
    start, end, rows = word_spans(lower, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hasher.spans(hasher.prefix(lower), start, end)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    found = [(owner, h)]
    for gap in _PAIRS:
        same = owner[:-gap] == owner[gap:]
        found.append((owner[gap:][same], mix(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] ^ np.uint64(gap)))[same]))
    same = owner[:-2] == owner[2:]
    found.append((owner[2:][same], mix((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[same]))
    row, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, (value >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates over rows of distinct binary features; the bias isn't regularised."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.5
    l2: float = 0.0
    epochs: int = 4

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
        """Weights of ``size`` features, and the bias at the end."""
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        l1 = np.full(size + 1, self.l1)
        l1[-1] = 0.0
        for _ in range(self.epochs):
            for x, y in zip(rows, labels, strict=True):
                at = np.append(x, size)
                zx, nx = z[at], n[at]
                w = self._weights(zx, nx, l1[at])
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                root = np.sqrt(nx + g * g)
                z[at] = zx + g - (root - np.sqrt(nx)) / self.alpha * w
                n[at] = nx + g * g
        return self._weights(z, n, l1)

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)


@dataclass(frozen=True)
class Model:
    """Non-zero weights by (sorted) feature index, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def filter(self) -> np.ndarray:
        """Which features have a weight."""
        out = np.zeros(1 << BITS, bool)
        out[self.index] = True
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, known: np.ndarray) -> np.ndarray:
        row, at = features(data, offsets, hasher)
        hit = known[at]
        pair = np.unique((row[hit] << BITS) | at[hit])
        weights = self.weight[np.searchsorted(self.index, pair & _MASK)]
        total = np.bincount(pair >> BITS, weights=weights, minlength=len(offsets) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35, 35)))


def train(rows: list[np.ndarray], labels: np.ndarray, learner: Ftrl) -> Model:
    """Fit rows of distinct feature indices."""
    counts = np.zeros(1 << BITS, np.uint16)
    for x in rows:
        counts[x] += counts[x] < 65_535
    kept = np.flatnonzero(counts >= MIN_DOCS)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    dense = [p[p >= 0] for p in (place[x] for x in rows)]
    del counts, place
    w = learner.fit(dense, labels, len(kept))
    at = np.flatnonzero(w[:-1])
    return Model(kept[at], w[at], float(w[-1]))


def sample_ids(labels: DataFrame, label: str, usable, max_rows: int) -> DataFrame:
    """At most ``max_rows`` distinct labelled ids with their largest label, in the order of a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    one = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def sampled_texts(docs: DataFrame, ids: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``id, y, text``: one row for each of ``ids`` that ``docs`` has, of several rows that of the least text hash.

    Repeats are dropped where they are, so no task gets more rows of an id than there are partitions. In the order of a
    hash of the id whole texts are taken as long as they come to ``max_bytes`` at most (and one in any case).
    """
    # The ids are at most max_rows pairs of numbers, so they go to the texts and not the other way round.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("id"))
    one = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    texts = materialize(one.select("id", "y", "least.text"), "sample")
    # One window over a row of two numbers for each sampled id.
    so_far = Window.orderBy(F.xxhash64("id"), "id")
    sizes = texts.select("id", F.octet_length("text").cast("long").alias("size"))
    few = sizes.withColumns({"nth": F.row_number().over(so_far), "total": F.sum("size").over(so_far)}).where((F.col("nth") == 1) | (F.col("total") <= max_bytes))
    return texts.join(F.broadcast(few.select("id")), "id")


def fit(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic", max_rows: int = MAX_ROWS, learner: Ftrl | None = None, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from labelled rows for which ``usable`` holds; without any, every score is 0.5.

    The sample is bounded by ``max_rows`` rows and ``max_bytes`` of text (some five features of four bytes a word).

    Labels other than 0 and 1 are left out; of several labels of one doc_id the largest counts, of several rows one.
    """
    learner = learner or Ftrl()
    ids = sample_ids(labels, label, usable, max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            packed = []
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                row, at = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)
                pair = np.unique((row << BITS) | at)
                cuts = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
                packed += [(pair[a:b] & _MASK).astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(packed, pa.binary())], ["id", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            labels += batch.column("y").to_pylist()
            rows += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("x")]  # no copies
        if rows:
            order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], len(rows[i])))
            model = train([rows[i] for i in order], np.array([labels[i] for i in order], float), learner)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    packed = sampled_texts(docs, ids, max_bytes).mapInArrow(lean(extract), "id long, y int, x binary")
    found = packed.repartition(1).mapInArrow(lean(learn), "model binary").first()
    return pickle.loads(found["model"]) if found else Model(np.zeros(0, np.int64), np.zeros(0), 0.0)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of its whole text (null: empty; without words: that of the bias), replacing ``column``."""
    names = [c for c in docs.columns if c != column]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = SpanHasher(), model.filter()
        for batch in batches:
            data, offsets = utf8(batch.column(at).cast(pa.string()))
            scores = [model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher, known) for lo, hi in slices(offsets, _CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*names, column])

    rows = docs.select(*quoted(*names))
    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def remainder(n: int):
    """crc32 of the doc_id as text (null: empty text) modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
