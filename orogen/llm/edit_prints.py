"""Fingerprints of documents by randomised edit embedding, with bit-sampled bands and verification.

A walk over a text puts out the character it stands on at every step and moves on by one where a random bit of step and
character says so. All texts share the bits, so two walks meet again soon after an edit, and the Hamming distance of what
they put out follows the edit distance of the texts. From that embedding runs of ``WIDTH`` coordinates are sampled, one
in every block of steps, and hashed to a byte each. Blocks double with the length of the text and the samples of longer
blocks are among those of shorter ones, so a fingerprint covers the whole text in at most ``SAMPLES`` bytes a walk and
can be compared with that of any other length.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, map_batches, materialize, mix, text_or_empty

#: Independent walks, samples of a walk at most, steps of the shortest block, coordinates of a sample.
WALKS, SAMPLES, BLOCK, WIDTH = 2, 128, 8, 8
#: Random bits repeat after this many steps (a power of two); characters walk by one of so many classes.
PERIOD, CLASSES = 4096, 256
#: Samples of one band.
BAND = 4
#: Characters worked on at once, and texts that are worth stepping side by side.
_CHUNK, _LANES = 3_000_000, 32
_SEED = 20_240_611
#: Digests and fingerprints are hex strings in results only, as they take half the room in storage without.
_HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")
_ROW = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, bands_edited int, bands_next int"


def _hashed(*values: np.ndarray | int) -> np.ndarray:
    h = np.full(1, _SEED, np.uint64)
    for v in values:
        h = mix((h ^ np.asarray(v).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15))
    return h


def classes_of(codes: np.ndarray) -> np.ndarray:
    return (_hashed(codes) % np.uint64(CLASSES)).astype(np.uint8)


@functools.cache
def move_bits(walk: int) -> np.ndarray:
    """Whether a walk moves on at a step (modulo PERIOD) from a character of a class."""
    bits = np.random.default_rng([_SEED, walk]).integers(0, 2, (PERIOD, CLASSES)).astype(bool)
    bits[0] |= ~bits.any(axis=0)
    return bits


@functools.cache
def _stays() -> tuple[np.ndarray, list[list[bytes]]]:
    """Steps spent on a character by walk, step of entry and class: times CLASSES in one flat table, and as bytes."""
    stays = np.zeros((WALKS, PERIOD, CLASSES), np.int32)
    for walk in range(WALKS):
        bits, ahead = move_bits(walk), np.zeros(CLASSES, np.int32)
        for j in [*range(PERIOD), *range(PERIOD)][::-1]:
            stays[walk, j] = ahead = np.where(bits[j], 1, ahead + 1)
    return (stays * CLASSES).ravel(), [[bytes(column) for column in own.T.astype(np.uint8).copy()] for own in stays]


def _walked(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Steps spent on each character by each walk: all texts and walks side by side, the few longest at last alone."""
    flat, by_class = _stays()
    out = np.zeros((WALKS, len(classes)), np.uint8)
    sizes = np.diff(offsets)
    order = np.repeat(np.argsort(-sizes, kind="stable"), WALKS)
    walk = np.tile(np.arange(WALKS), len(sizes))
    begins, sizes = offsets[:-1][order], sizes[order]
    live = len(sizes) - np.cumsum(np.bincount(sizes)) if len(sizes) else np.zeros(1, np.int64)
    base, state, at = (walk * PERIOD * CLASSES).astype(np.int32), np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    wrap, i, written = np.int32(PERIOD * CLASSES - 1), 0, out.ravel()
    while live[i] >= _LANES:
        k, last = int(live[i]), min(i + 64, int(sizes[_LANES - 1]))
        place = begins[:k] + np.arange(i, last)[:, None]
        rows = classes.take(place, mode="clip") + base[:k]
        stay = np.zeros(rows.shape, np.int32)
        for n, r in zip(live[i:last].tolist(), range(last - i), strict=True):
            np.add(rows[r, :n], state[:n], out=at[:n])
            flat.take(at[:n], out=stay[r, :n], mode="clip")
            state[:n] += stay[r, :n]
            state[:n] &= wrap
        inside = place < (begins + sizes)[:k]
        written[(place + walk[:k] * len(classes))[inside]] = (stay // CLASSES)[inside]
        i = last
    for lane in range(int(live[i])):
        step, own, rest = int(state[lane]) // CLASSES, [], slice(int(begins[lane]) + i, int(begins[lane] + sizes[lane]))
        stays = by_class[walk[lane]]
        for c in classes[rest].tolist():
            n = stays[c][step & (PERIOD - 1)]
            own.append(n)
            step += n
        out[walk[lane], rest] = own
    return out


def _finer(level: np.ndarray | int, block: np.ndarray) -> np.ndarray:
    """The block of the next lower level whose sample a block takes."""
    return 2 * block + (_hashed(level, block) & np.uint64(1)).astype(np.int64)


def sample_steps(level: int, blocks: np.ndarray) -> np.ndarray:
    """First steps of the samples of ``blocks`` at a level."""
    for own in range(level, 0, -1):
        blocks = _finer(own, blocks)
    return BLOCK * blocks + (_hashed(0, blocks) % np.uint64(BLOCK)).astype(np.int64)


def _sample_bytes(window: np.ndarray) -> np.ndarray:
    """A byte for each row of coordinates; a coordinate beyond the end is 0, any other its code point plus 1."""
    h = np.zeros(len(window), np.uint64)
    for k in range(window.shape[1]):
        h = mix((h + window[:, k]) * np.uint64(0x9FB21C651E98DF25))
    return (h >> np.uint64(56)).astype(np.uint8)


_PAD = int(_sample_bytes(np.zeros((1, WIDTH), np.uint64))[0])


@dataclass(frozen=True)
class Print:
    """Level and sample bytes of each walk."""

    walks: tuple[tuple[int, bytes], ...]

    def packed(self) -> bytes:
        """Level, number of samples and samples of each walk."""
        return b"".join(bytes([level, len(data)]) + data for level, data in self.walks)

    @classmethod
    def parse(cls, packed: bytes) -> Print:
        walks = []
        while packed:
            walks.append((packed[0], packed[2 : 2 + packed[1]]))
            packed = packed[2 + packed[1] :]
        return cls(tuple(walks))


def prints_of(texts: list[str]) -> list[Print]:
    """Fingerprints of whole texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = classes_of(codes)
    per_walk = []
    for stays in _walked(classes, offsets):
        ends = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])[offsets]
        steps = np.diff(ends)
        blocks = -(-steps // BLOCK)
        level = np.zeros(len(texts), np.int64)
        while (more := blocks > SAMPLES).any():
            level[more] += 1
            blocks[more] = -(-blocks[more] // 2)
        first = np.concatenate([[0], np.cumsum(blocks)])
        own = np.repeat(np.arange(len(texts)), blocks)
        block = np.arange(first[-1]) - first[own]
        for n in range(int(level.max(initial=0)), 0, -1):
            at = level[own] >= n
            block[at] = _finer(n, block[at])
        begin = BLOCK * block + (_hashed(0, block) % np.uint64(BLOCK)).astype(np.int64)
        embedded = np.repeat(codes, stays)
        place = begin[:, None] + np.arange(WIDTH)
        inside = place < steps[own][:, None]
        window = np.zeros(place.shape, np.uint64)
        window[inside] = embedded[(place + ends[own][:, None])[inside]].astype(np.uint64) + np.uint64(1)
        data = _sample_bytes(window).tobytes()
        per_walk.append([(int(lv), data[a:b]) for lv, a, b in zip(level, first[:-1], first[1:], strict=True)])
    return [Print(own) for own in zip(*per_walk, strict=True)]


@functools.cache
def _taken(below: int, level: int) -> np.ndarray:
    """Which samples of the level ``below`` are those of ``level``."""
    blocks = np.arange(SAMPLES)
    for own in range(level, below, -1):
        blocks = _finer(own, blocks)
    return blocks


def at_level(level: int, data: bytes, wanted: int) -> np.ndarray:
    """The samples of a coarser level that the text has blocks for."""
    own = np.frombuffer(data, np.uint8)
    if level == wanted:
        return own
    blocks = _taken(level, wanted)[: -(-len(own) // 2 ** (wanted - level))]
    return np.where(blocks < len(own), own[np.minimum(blocks, len(own) - 1)], np.uint8(_PAD))


def compare(a: Print, b: Print) -> tuple[float, int]:
    """Likeness and shared bands: the share of equal samples at the coarser of the two levels (1 for empty texts), and
    the number of equal bands there, each in the walk where it is largest. From one shared band on two texts are
    candidates of each other."""
    best, met = 0.0, 0
    for (la, da), (lb, db) in zip(a.walks, b.walks, strict=True):
        x, y = at_level(la, da, max(la, lb)), at_level(lb, db, max(la, lb))
        n, most = min(len(x), len(y)), max(len(x), len(y))
        if not most:
            return 1.0, 1
        same = x[:n] == y[:n]
        best = max(best, float(np.count_nonzero(same)) / most)
        whole = n // BAND * BAND
        alike = np.count_nonzero(same[:whole].reshape(-1, BAND).all(axis=1)) + (whole < n == most and len(x) == len(y) and same[whole:].all())
        met = max(met, int(alike))
    return best, met


def bands(own: Print) -> dict[tuple[int, int], list[str]]:
    """Keys by walk and level, at the text's own level and the next: a band is ``BAND`` samples and their place."""
    out = {}
    for walk, (level, data) in enumerate(own.walks):
        for wanted in (level, level + 1):
            values = at_level(level, data, wanted).tobytes() if data else b""
            out[walk, wanted] = [f"{walk}.{wanted}.{k}.{values[k : k + BAND].hex()}" for k in range(0, max(len(values), 1), BAND)]
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of some ``_CHUNK`` bytes of text, a longer text on its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + _CHUNK, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fingerprints(docs: DataFrame, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a string column ``into``, which replaces one of that name.

    Equal texts have equal fingerprints. A null or empty text has no samples; a very long one is walked whole and as
    wide as any other. Rows that repeat get the same, an empty table stays empty, other columns stay as they are.
    """
    text, own = fresh(docs, "text", "print")
    schema = StructType([*docs.schema.fields, StructField(own, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, text):
                found = pa.array([p.packed().hex() for p in prints_of(part.column(text).to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=schema.names)

    rows = map_batches(docs.withColumn(text, text_or_empty()), run, schema)
    return rows.withColumn(into, F.col(own)).drop(own)


def _results(rows: list[tuple[int, str, Print]], following: list[Print], changed: list[str], of_changed: list[Print]) -> list[tuple]:
    out = []
    for (doc_id, text, own), after, new, of_new in zip(rows, following, changed, of_changed, strict=True):
        (near_new, met_new), (near_after, met_after) = compare(own, of_new), compare(own, after)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).digest(), own.packed(), of_new.packed(), near_new, near_after, met_new, met_after))
    return out


_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2, *[pa.int32()] * 2]
_EDGE = ["kind", "part", "edge_id", "edge_text", "edge_print"]


def _batch(kind: str, rows: list[tuple], edge: tuple | None = None) -> pa.RecordBatch:
    """Finished rows, or the row that stands at an edge of a partition."""
    n = 1 if edge else len(rows)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.nulls(n, t) for t in _TYPES]
    part, doc_id, text, own = edge or (None, None, None, None)
    edges = [pa.array([v] * n, t) for v, t in ((kind, pa.string()), (part, pa.int32()), (doc_id, pa.int64()), (text, pa.string()), (own and own.packed(), pa.binary()))]
    return pa.RecordBatch.from_arrays([*edges, *columns], names=[*_EDGE, *_COLUMNS])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the sorted rows of a partition: each row with the next; the first and the last row are put out as edges."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for piece in _chunks(batch, "text"):
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            ahead = [held[1], *texts] if held else texts
            changed = [edited(text, after) for text, after in zip(ahead, ahead[1:], strict=False)]
            prints = prints_of(texts + changed)
            rows = list(zip(ids, texts, prints[: len(texts)], strict=True))
            if held is None:
                yield _batch("first", [], (part, *rows[0]))
            else:
                rows.insert(0, held)
            if changed:
                yield _batch("row", _results(rows[:-1], [r[2] for r in rows[1:]], changed, prints[len(texts) :]))
            held = rows[-1]
    if held is not None:
        yield _batch("last", [], (part, *held))


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            doc_id, text, own, after, of_after = (batch.column(c)[k].as_py() for c in ("edge_id", "edge_text", "edge_print", "after_text", "after_print"))
            changed = [edited(text, after)]
            rows = _results([(doc_id, text, Print.parse(own))], [Print.parse(of_after)], changed, prints_of(changed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_COLUMNS)


def against_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text (its last half replaced by the start of the next document, see
    ``edited``), and how near the two are, and it and the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited,
    bands_next``, a row for every row. The next document is that of the next doc_id, after the last the first; rows that
    repeat a doc_id follow each other by the hash of their text, and a null doc_id stands before all others. Null texts
    are empty; an empty text is like an empty one by 1 and like no other. Columns other than doc_id and text go, an empty
    table gives none.

    Rows are range-partitioned by doc_id and hash of the text and sorted, and a task streams its rows, holding one chunk
    and one row. The rows at the edges of partitions, two a partition, are joined in a step of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h1"), F.col("h2")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    staged = materialize(dealt.mapInArrow(_in_order, f"kind string, part int, edge_id long, edge_text string, edge_print binary, {_ROW}"), "prints")
    first = staged.where("kind = 'first'")
    # One row a partition, without its text: bounded by the number of partitions.
    turn = first.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    turn = turn.select("part", F.coalesce("after", "least").alias("after"))
    follow = first.select(F.col("part").alias("after"), F.col("edge_text").alias("after_text"), F.col("edge_print").alias("after_print"))
    last = staged.where("kind = 'last'").select(*_EDGE[1:])
    edges = last.join(turn, "part").join(follow, "after").drop("after", "part")
    found = staged.where("kind = 'row'").select(*_COLUMNS).union(edges.mapInArrow(_at_edges, _ROW))
    return found.select(*[F.lower(F.hex(c)).alias(c) if c in _HEX else F.col(c) for c in _COLUMNS])


def _banded(printed: DataFrame, key: str) -> DataFrame:
    """``key``, and a row per walk and level with the bands of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, sizes = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for own in bands(Print.parse(bytes.fromhex(text))).values():
                    ids += [doc_id] * len(own)
                    found += own
                    sizes += [len(own)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(sizes, pa.int32())], names=[key, "band", "size"])

    return printed.select(key, "fingerprint").mapInArrow(run, f"{key} long, band string, size int")


def search(docs: DataFrame, queries: DataFrame, least: float = 0.5, max_edits: float = 0.2) -> DataFrame:
    """``query_id, doc_id, edits`` for texts of ``docs`` near a text of ``queries`` (both doc_id, text).

    Candidates share at least ``least`` of their bands in one walk; verified are those within ``max_edits`` edits a
    character of the longer text. A set of bands is looked up by its rarest ones alone, as many as a set that shares
    enough must meet in, so that passages shared by many documents bring no candidates by themselves. A query's own row
    is found too. Documents of one text count once here and are joined again at the end. Null ids and texts take no
    part; no result for an empty table.
    """
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = queries.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("query_text"))
    key = F.sha2("text", 256)
    distinct = own.withColumn("sha", key).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    held = materialize(fingerprints(distinct), "texts")
    seek = materialize(fingerprints(asked.groupBy(F.sha2("query_text", 256).alias("sha")).agg(F.min("query_id").alias("query_id"), F.first("query_text").alias("text"))), "asked")
    ours, theirs = materialize(_banded(held, "doc_id"), "bands"), _banded(seek, "query_id")
    common = ours.groupBy("band").agg(F.count(F.lit(1)).alias("n"))

    def rare(banded: DataFrame, name: str) -> DataFrame:
        walk_level = F.substring_index("band", ".", 2)
        ordered = banded.join(common, "band", "left").groupBy(name, walk_level.alias("set")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "band"))).alias("b"))
        return ordered.select(name, F.explode(F.slice("b.band", F.lit(1), F.col("size") - F.ceil(F.col("size") * F.lit(least)).cast("int") + 1)).alias("band"))

    pairs = rare(theirs, "query_id").join(rare(ours, "doc_id"), "band").select("query_id", "doc_id").distinct()
    texts = pairs.join(seek.select("query_id", F.col("text").alias("query_text"), F.col("sha").alias("query_sha")), "query_id").join(held.select("doc_id", "text", "sha"), "doc_id")
    allowed = F.floor(F.greatest(F.length("text"), F.length("query_text")) * F.lit(max_edits)).cast("int")
    found = texts.withColumn("edits", F.call_function("levenshtein", "text", "query_text", allowed)).where("edits >= 0").select("query_sha", "sha", "edits")
    every = asked.select("query_id", F.sha2("query_text", 256).alias("query_sha")).join(found, "query_sha")
    return every.join(own.select("doc_id", key.alias("sha")), "sha").select("query_id", "doc_id", "edits")
