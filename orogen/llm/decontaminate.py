"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are word windows. Per pattern length there is a shift table over blocks of two words: where a block ends no
pattern, the search moves on by the least distance to one that it does end. Where the shift is zero, the hash of the
suffix block and that of the prefix block select candidate patterns, and the words themselves are then compared.
All segments of an Arrow batch advance in step, so a step of the search is a few vector operations.

Scale: one pass over the documents and no shuffle where the benchmark has at most ``slice_chars`` characters. A larger
one is taken in slices, one pass each: its tables are built, sent out and given up before the next, so no process holds
more than one slice's (some 8 bytes a character), and texts with hits are left in storage and joined at the end.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ASCII_LOWER, SpanHasher, fresh, map_batches, materialize, mix, quoted, slices, text_or_empty, utf8, word_spans

WINDOW = 13
SLICE_CHARS = 4_000_000
_SEGMENT = 192
_CHUNK_BYTES = 2_000_000


def _words(text: str | None) -> tuple[bytes, ...]:
    data = ASCII_LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    whole = data.tobytes()
    return tuple(whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))


def _block(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


class WuManber:
    """Tables for the windows of ``m`` words among the words of some items.

    ``vocabulary`` holds the distinct words, ``text`` their numbers in all items one after another, ``starts`` where a
    window starts in it and ``owners`` the item it belongs to.
    """

    def __init__(self, vocabulary: list[bytes], text: np.ndarray, starts: np.ndarray, owners: np.ndarray, m: int, hasher: SpanHasher) -> None:
        self.m, self.block, self.text = m, min(2, m), text
        self.data = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.cuts = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary], dtype=np.int64)])
        h = hasher.spans(hasher.prefix(self.data), self.cuts[:-1], self.cuts[1:])[text]
        # Equal windows of several items are one pattern; its items follow one another in ``items``.
        windows, pattern = np.unique(text[starts[:, None] + np.arange(m)], axis=0, return_inverse=True)
        pattern = pattern.ravel()
        self.patterns = np.zeros(len(windows), np.int64)
        self.patterns[pattern] = starts
        pairs = np.unique(np.stack([pattern, owners]), axis=1)
        self.items, self.bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(windows) + 1))
        # Four slots a word at least, so that few blocks fall on the slot of another.
        self.bits = max(10, int(len(text)).bit_length() + 2)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int16)
        for j in range(self.block, m + 1):
            np.minimum.at(self.shift, self.slot(self.block_hash(h, self.patterns + j - 1)), np.int16(m - j))
        key = _block(self.block_hash(h, self.patterns + m - 1), self.block_hash(h, self.patterns + self.block - 1))
        order = np.argsort(key, kind="stable")
        self.keys, self.patterns_by_key = key[order], order

    def block_hash(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        return h[last] if self.block == 1 else _block(h[last - 1], h[last])

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a pattern may start and where in ``keys`` its bucket starts. Lanes cover word ranges."""
        m, found, buckets = self.m, [], []
        here, stop = first + m - 1, last
        lanes = here < stop
        here, stop = here[lanes], stop[lanes]
        while len(here):
            suffix = self.block_hash(h, here)
            step = self.shift[self.slot(suffix)].astype(np.int64)
            hit = step == 0
            if hit.any():
                at = here[hit]
                key = _block(suffix[hit], self.block_hash(h, at - m + self.block))
                low = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                good = self.keys[low] == key
                found.append(at[good] - m + 1)
                buckets.append(low[good])
            here = here + np.maximum(step, 1)
            alive = here < stop
            here, stop = here[alive], stop[alive]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(found), np.concatenate(buckets)) if found else (empty, empty)

    def confirm(self, lower: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those word positions ``at`` where a pattern of the bucket occurs, and the pattern, by direct comparison."""
        places, patterns = [], []
        while len(at):
            candidate = self.patterns_by_key[bucket]
            equal = np.ones(len(at), bool)
            for j in range(self.m):
                word = self.text[self.patterns[candidate] + j]
                size = end[at + j] - start[at + j]
                equal &= size == self.cuts[word + 1] - self.cuts[word]
                rest = np.flatnonzero(equal)
                many = size[rest]
                of = np.repeat(np.arange(len(rest)), many)
                byte = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                differs = lower[start[at[rest] + j][of] + byte] != self.data[self.cuts[word[rest]][of] + byte]
                equal[rest[np.unique(of[differs])]] = False
            places.append(at[equal])
            patterns.append(candidate[equal])
            # A pattern of the same key may follow in the bucket.
            more = ~equal & (bucket + 1 < len(self.keys))
            more[more] = self.keys[bucket[more] + 1] == self.keys[bucket[more]]
            at, bucket = at[more], bucket[more] + 1
        return (np.concatenate(places), np.concatenate(patterns)) if places else (at, at)


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[str], list[WuManber]]:
    """Names of the items, and tables for each length of window that they have."""
    names = sorted({item for item, _ in items})
    number = {item: i for i, item in enumerate(names)}
    known: dict[bytes, int] = {}
    text: list[int] = []
    starts: dict[int, list[np.ndarray]] = defaultdict(list)
    owners: dict[int, list[np.ndarray]] = defaultdict(list)
    for item, words in ((item, _words(t)) for item, t in items):
        if words:
            m = min(window, len(words))
            own = len(text) + np.arange(len(words) - m + 1)
            starts[m].append(own)
            owners[m].append(np.full(len(own), number[item]))
            text += [known.setdefault(w, len(known)) for w in words]
    hasher, numbers = SpanHasher(), np.array(text, np.int32)
    return names, [WuManber(list(known), numbers, np.concatenate(starts[m]), np.concatenate(owners[m]), m, hasher) for m in sorted(starts)]


def _search_rows(data: np.ndarray, offsets: np.ndarray, names: list[str], tables: list[WuManber], hasher: SpanHasher):
    """Per row: its number of words, maximal hit word ranges, and items."""
    lower = ASCII_LOWER[data]
    start, end, rows = word_spans(lower, offsets)
    n = len(offsets) - 1
    items: list[set[int]] = [set() for _ in range(n)]
    marks = np.zeros(len(start) + 1, np.int64)
    if len(start) and tables:
        h = hasher.spans(hasher.prefix(lower), start, end)
        counts = np.diff(rows)
        parts = -(-counts // _SEGMENT)
        row = np.repeat(np.arange(n), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = rows[row] + nth * _SEGMENT
        for t in tables:
            at, bucket = t.search(h, first, np.minimum(first + _SEGMENT + t.m - 1, rows[row + 1]))
            at, pattern = t.confirm(lower, start, end, at, bucket)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + t.m, -1)
            owner = np.searchsorted(rows, at, side="right") - 1
            for r, p in np.unique(np.stack([owner, pattern]), axis=1).T.tolist():
                items[r].update(t.items[t.bounds[p] : t.bounds[p + 1]].tolist())
    hit = np.cumsum(marks[:-1]) > 0
    for r in range(n):
        lo, hi = rows[r], rows[r + 1]
        spans = []
        if items[r]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
            spans = [{"first": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)]
        yield int(hi - lo), spans, [names[i] for i in sorted(items[r])]


_SPANS = "array<struct<first:int,stop:int>>"
_FOUND = f"struct<n_words:int,hit_spans:{_SPANS},items:array<string>>"
_FOUND_TYPE = pa.struct([("n_words", pa.int32()), ("hit_spans", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _searched(docs: DataFrame, column: str, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """``docs`` with the struct ``column`` of what ``items`` have in its text, in one pass."""
    names, tables = build(items, window)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, docs.select(F.expr(f"cast(null as {_FOUND})")).schema[0].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column(at).cast(pa.string()))
            found = []
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                found += _search_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], names, tables, hasher)
            rows = [{"n_words": n, "hit_spans": spans, "items": own} for n, spans, own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _FOUND_TYPE)], [*batch.schema.names, column])

    return map_batches(docs, run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "contamination", window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` with a struct ``column``: ``n_words``, ``hit_spans`` (disjoint word ranges inside an occurrence) and
    ``items`` (sorted strings). A column of ``docs`` of that name is replaced, all others are kept.

    An item of fewer words than the window, but at least one, is one window; an item or document without words, a
    null text included, neither hits nor is hit. Items with a null item_id are left out; rows that repeat an item
    count once. Rows of ``docs`` that repeat get repeated results, and an empty table or benchmark is no error.
    """
    docs = docs.drop(column)
    held = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = held.agg(F.sum(F.length(text_or_empty()))).first()[0] or 0
    many = max(1, math.ceil(size / slice_chars))

    def part(k: int) -> list[tuple[str, str | None]]:
        own = held if many == 1 else held.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k)
        return [(r["item"], r["text"]) for r in own.orderBy("item", "text").collect()]

    if many == 1:
        return _searched(docs, column, part(0), window)
    # A pass for each slice leaves the texts with hits in storage, by a 128-bit digest of the text.
    text = text_or_empty()
    digest = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    texts = docs.select(*digest, text.alias("text"))
    passes = []
    for k in range(many):
        found = _searched(texts, "found", part(k), window).where(F.size("found.items") > 0).select("t1", "t2", "found")
        passes.append(materialize(found, f"hits-{k}"))
    hits = functools.reduce(DataFrame.union, passes).distinct().groupBy("t1", "t2").agg(F.collect_list("found").alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                spans = functools.reduce(_union, (f["hit_spans"] for f in found))
                rows.append({"n_words": found[0]["n_words"], "hit_spans": spans, "items": sorted({i for f in found for i in f["items"]})})
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(rows, _FOUND_TYPE)], ["t1", "t2", "found"])

    d1, d2, h1, h2, hit, none = fresh(docs, "d1", "d2", "h1", "h2", "hit", "none")
    merged = hits.mapInArrow(merge, f"t1 long, t2 long, found {_FOUND}").toDF(h1, h2, hit)
    keyed = _searched(docs, none, [], window).withColumns({d1: digest[0], d2: digest[1]})
    joined = keyed.join(merged, (F.col(d1) == F.col(h1)) & (F.col(d2) == F.col(h2)), "left")
    return joined.withColumn(column, F.coalesce(hit, none)).select(*quoted(*docs.columns, column))


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for span in sorted([*a, *b], key=lambda s: s["first"]):
        if merged and span["first"] <= merged[-1]["stop"]:
            merged[-1]["stop"] = max(merged[-1]["stop"], span["stop"])
        else:
            merged.append(dict(span))
    return merged


def n_hit(column: str = "contamination"):
    return F.aggregate(f"{column}.hit_spans", F.lit(0).cast("long"), lambda total, s: total + (s["stop"] - s["first"]).cast("long"))


def is_contaminated(column: str = "contamination"):
    """The contamination rule over the column of :func:`contamination`: hit words are at least 5 % of the words."""
    return (n_hit(column) > 0) & (20 * n_hit(column) >= F.col(f"{column}.n_words"))
