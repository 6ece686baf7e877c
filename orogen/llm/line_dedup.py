"""Line deduplication by a range-partitioned sort of line hashes that returns keep bitmaps instead of text.

A row per document and distinct line key (a 128-bit hash) is range-partitioned by hash and document and sorted within
partitions by hash, document (largest first) and position. A task streams its runs: the first row of a run is the
occurrence to keep. Ranges cut even the hottest key across tasks, because the document is part of the range key; runs
that touch the edge of a partition are resolved from a summary of at most two rows per partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIN_LONG, fresh, lean, map_batches, materialize, text_or_empty, utf8

BLANK = b" \t\n\r\x0b\x0c"
_KEYED = "h1 long, h2 long, doc_key long, row_key long, n_lines int, positions array<int>"
_STAGED = "kind string, h1 long, h2 long, doc_key long, row_key long, n_lines int, positions array<int>, n_docs long"


def _with_keys(docs: DataFrame, doc_key: str, row_key: str) -> DataFrame:
    """doc_key: the doc_id, a null one as one document below all others; row_key tells texts of one doc_id apart."""
    return docs.withColumns({doc_key: F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)), row_key: F.xxhash64(text_or_empty())})


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per document and distinct key of at least ``min_chars`` code points, with the positions of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole, at = data.tobytes(), offsets.tolist()
            h1, h2, row, counts, places = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                seen: dict[bytes, list[int]] = {}
                lines = whole[a:b].split(b"\n")
                for n, line in enumerate(lines):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        seen.setdefault(xxhash.xxh3_128_digest(key.lower()), []).append(n)
                for digest, where in seen.items():
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    row.append(i)
                    counts.append(len(lines))
                    places.append(where)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("doc_key").take(take), batch.column("row_key").take(take), pa.array(counts, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                ["h1", "h2", "doc_key", "row_key", "n_lines", "positions"],
            )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return _with_keys(rows, "doc_key", "row_key").select("doc_key", "row_key", "text").mapInArrow(lean(run), _KEYED)


def _stream_runs(min_docs: int):
    """Over sorted rows of one partition: dropped rows, rows of the first and the last run, and those runs' summaries."""

    def settle(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        h1, h2, doc = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_key"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        docs = np.bincount(run, weights=fresh).astype(np.int64)
        edge = np.zeros(len(starts), bool)
        edge[:1] |= first
        edge[-1:] |= last
        drop = (docs[run] >= min_docs) & (doc != doc[starts][run]) & ~edge[run]
        for kind, rows in (("drop", np.flatnonzero(drop)), ("open", np.flatnonzero(edge[run])), ("run", starts[edge])):
            part = table.take(pa.array(rows))
            part = part.append_column("n_docs", pa.array(docs[run[rows]])).add_column(0, "kind", pa.array([kind] * len(rows), pa.string()))
            yield from part.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            other = np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            same = held and held[-1].column("h1")[-1].as_py() == h1[0] and held[-1].column("h2")[-1].as_py() == h2[0]
            if cut or (held and not same):
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks(), first, False)
                held, first = [], False
            held.append(batch.slice(cut))
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks(), first, True)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_key, row_key, n_lines, n_dropped, keep`` for each document that loses a line.

    ``keep`` is zlib-compressed packed bits, one per line, the first line in the highest bit; documents without a row
    keep every line. The key of a line is the line without blanks (space, \\t to \\r) at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more lose their lines except in the largest
    doc_id. Rows that repeat a doc_id are one document; a null doc_id is one document below all others; a null or
    empty text is one empty line.
    """
    keyed = line_keys(docs, min_chars)
    order = [F.col("h1"), F.col("h2"), F.col("doc_key").desc()]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order, "row_key")
    staged = materialize(dealt.mapInArrow(lean(_stream_runs(min_docs)), _STAGED), "lines")
    runs = staged.where("kind = 'run'").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.max("doc_key").alias("keeper"))
    hot = runs.where(F.col("total") >= min_docs).select("h1", "h2", "keeper")
    # At most two runs per partition of the sort are open, whatever the input, so this side is bounded.
    late = staged.where("kind = 'open'").join(F.broadcast(hot), ["h1", "h2"]).where("doc_key <> keeper")
    columns = ["doc_key", "row_key", "n_lines", "positions"]
    dropped = staged.where("kind = 'drop'").select(*columns).union(late.select(*columns))
    gathered = dropped.groupBy("doc_key", "row_key", "n_lines").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, sizes = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("positions").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[places] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                sizes.append(len(places))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], ["doc_key", "row_key", "n_lines", "n_dropped", "keep"])

    return gathered.mapInArrow(lean(pack), "doc_key long, row_key long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return b"\n".join([lines[i] for i in np.flatnonzero(keep)])


def _joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` and, as the last two columns, the number of lines that a row loses and its bitmap."""
    doc_key, row_key, k1, k2, dropped, keep = fresh(docs, "doc_key", "row_key", "k1", "k2", "dropped", "keep")
    maps = bitmaps.select("doc_key", "row_key", "n_dropped", "keep").toDF(k1, k2, dropped, keep)
    rows = _with_keys(docs, doc_key, row_key)
    return rows.join(maps, (F.col(doc_key) == F.col(k1)) & (F.col(row_key) == F.col(k2)), "left").drop(doc_key, row_key, k1, k2)


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole, at = data.tobytes(), offsets.tolist()
            texts = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            shas = [hashlib.sha256(kept_lines(t, m)).hexdigest() for t, m in zip(texts, batch.columns[-1].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), batch.columns[-2].fill_null(0).cast(pa.int64()), pa.array(shas, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    rows = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), keep_bitmaps(docs, min_chars, min_docs))
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its repeated lines taken out of ``text``, all columns kept and ``n_chars`` (where there) renewed."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else t if m is None else kept_lines(t.encode(), m).decode()
                for t, m in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True)
            ]
            arrays = list(batch.columns[: len(names)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = map_batches(_joined(docs, keep_bitmaps(docs, min_chars, min_docs)), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
