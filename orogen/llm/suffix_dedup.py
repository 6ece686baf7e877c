"""Exact substring deduplication by suffix arrays built with linear suffix grouping.

A byte goes if a string of ``window`` bytes that covers it starts anywhere else. Windows are dealt by content:

1. Every window has a content-defined anchor, so equal windows share the anchor's hash and their place around it. An
   anchor stands for a run of windows, its *context* is the bytes under them. Contexts are range-partitioned by anchor,
   digest (128 bits) and row, which cuts even the hottest anchor across tasks.
2. Contexts of one anchor meet as text, if it has two occurrences or more; of equal ones two meet, and those after them
   have the verdict of these (the job fails if the text of these two does not bear out that the digests are equal).
   Aligned at the anchor, the bytes to its right form a trie, those to its left another, and a context is the string of
   trie nodes on its two paths. Windows of two contexts are equal exactly where these strings share a substring across
   the anchor.
3. A suffix array over the node strings of many anchors shows how far each suffix repeats elsewhere. It is built by
   grouping: suffixes are gathered by their Lyndon prefix in descending order of groups, through pointers to the
   previous smaller suffix, after which one ascending pass emits the order; nothing is renamed or sorted recursively.

An anchor with more than ``group`` contexts is dealt anew: its windows go by their distance from it, and the bytes that
all windows of about one distance hold are their new, finer anchor. Rounds take ever fewer distances together; where
it is one, the anchor is the window itself and has but one context. So no task holds an unbounded group.

Scale: what is shuffled is some sixty bytes per anchor (one for some 70 bytes of text, three for a run of repeats of
up to a hundred bytes, however long), the text itself compressed, and the contexts that meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import anchors
from .common import SpanHasher, discard, materialize, scratch, slices, text_or_empty, utf8, written

WINDOW = 200
GROUP = 1_000
_CHUNK_BYTES = 300_000
#: Texts that are unpacked at once.
_TEXTS = 500
_BATCH = 5_000
#: Full anchors that are broadcast at most; more are joined by shuffle.
_BROADCAST = 100_000
#: Distances from a full anchor that are taken together, from round to round; the last tells single windows apart.
_WIDTHS = (43, 11, 3, 1)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of numbers, by grouping. The end of the text counts as smaller than every number."""
    n = len(text) + 1
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    order = sorted(by_symbol)
    # Groups form a linked list in ascending order; group 0 holds the end of the text alone.
    members: list[list[int]] = [[n - 1], *[by_symbol[s] for s in order]]
    above = [*range(1, len(members)), -1]
    below = [-1, *range(len(members) - 1)]
    size = [len(m) for m in members]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    done = [False] * len(members)
    previous = [-1] * n
    g = len(members) - 1
    while g > 0:
        done[g] = True  # from here on only suffixes of lower groups are smaller
        own = [i for i in members[g] if group[i] == g]
        if own:
            pointed: dict[int, int] = {}
            for i in own:  # in text order, so that those passed on the way know their own previous
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            if pointed:
                _advance(pointed, members, size, group, above, below, done)
        g = below[g]
    # Ranks of the groups, then one pass that puts each suffix at the front of what is left of its group.
    front = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        front[g] = at
        at += size[g]
        g = above[g]
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for rank in range(n):
        i = out[rank] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = True
            i = previous[i]
    return out[1:]


def _advance(pointed: dict[int, int], members: list, size: list, group: list, above: list, below: list, done: list) -> None:
    """Move the suffixes that were pointed at into new groups right above their own, most pointers first."""
    by_count: dict[int, dict[int, list[int]]] = {}
    for p in sorted(pointed):
        by_count.setdefault(pointed[p], {}).setdefault(group[p], []).append(p)
    for count in sorted(by_count, reverse=True):
        for old, moved in by_count[count].items():
            if len(moved) == size[old]:
                continue  # the whole group moves, which changes nothing
            new = len(members)
            size[old] -= len(moved)  # its list keeps those that left, which then name another group
            size.append(len(moved))
            members.append(moved)
            done.append(False)
            above.append(above[old])
            below.append(old)
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
            for p in moved:
                group[p] = new


def repeats(text: list[int]) -> list[int]:
    """For each suffix, the length of its longest prefix that starts anywhere else."""
    order = suffix_array(text)
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * (n + 1), 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[i] = max(out[i], h)
            out[j] = max(out[j], h)
            h = max(h - 1, 0)
        else:
            h = 0
    return out[:n]


def _paths(strings: list[bytes], first: int) -> tuple[list[list[int]], list[list[int]], int]:
    """Trie paths of strings: per string the depths where its nodes end, and their numbers, counted from ``first``."""
    n = len(strings)
    order = sorted(range(n), key=strings.__getitem__)
    shared = []
    for i, j in zip(order[:-1], order[1:], strict=True):
        a, b = strings[i], strings[j]
        size = min(len(a), len(b))
        differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
        shared.append(size - (differ.bit_length() + 7) // 8)
    depths: list[list[int]] = [[] for _ in range(n)]
    nodes: list[list[int]] = [[] for _ in range(n)]
    todo = [(0, n - 1, 0)]
    while todo:
        lo, hi, above = todo.pop()
        depth = len(strings[order[lo]]) if lo == hi else min(shared[lo:hi])
        if depth > above:
            for i in order[lo : hi + 1]:
                depths[i].append(depth)
                nodes[i].append(first)
            first += 1
        if lo < hi:
            start = lo
            for i in range(lo, hi):
                if shared[i] == depth:
                    todo.append((start, i, depth))
                    start = i + 1
            todo.append((start, hi, depth))
    return depths, nodes, first


def settle(contexts: list[tuple[int, bytes, int, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """Repeated windows of contexts ``(anchor, bytes, place of the anchor in them, windows)``, sorted by anchor.

    Yields the number of a context and the first and last start in it of a run of windows that occur elsewhere.
    """
    text: list[int] = []
    strings: list[tuple[int, list[int], list[int], int]] = []
    first, lo = 2, 0
    while lo < len(contexts):
        hi = lo
        while hi < len(contexts) and contexts[hi][0] == contexts[lo][0]:
            hi += 1
        if hi - lo > 1:
            left_depths, left, first = _paths([b[:at][::-1] for _, b, at, _ in contexts[lo:hi]], first)
            right_depths, right, first = _paths([b[at:] for _, b, at, _ in contexts[lo:hi]], first)
            for k in range(hi - lo):
                strings.append((lo + k, left_depths[k], right_depths[k], len(text)))
                text += left[k][::-1]
                text += right[k]
                text.append(1)
        lo = hi
    longest = repeats(text)
    for k, left_depth, right_depth, start in strings:
        _, _, at, windows = contexts[k]
        lower = 0
        low_reach, high_reach = at - windows + 1, at  # bytes before the anchor of the last and the first window
        for t, upper in enumerate([0, *left_depth]):
            # Windows that reach (lower, upper] bytes before the anchor start in the t-th node to its left.
            reached = min(longest[start + len(left_depth) - t] - t, len(right_depth))
            if reached > 0:
                near = max(lower + (t > 0), window - right_depth[reached - 1], low_reach)
                far = min(upper, high_reach)
                if near <= far:
                    yield k, at - far, at - near
            lower = upper


def _keyed(docs: DataFrame) -> DataFrame:
    """``row1, row2``: a 128-bit digest of doc_id (null: apart from all others) and text, which rows of one kind share."""
    text = text_or_empty()
    doc_id = F.col("doc_id").cast("long")
    digest = [F.xxhash64(F.lit(seed), doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text).alias(f"row{seed}") for seed in (1, 2)]
    return docs.select(doc_id.alias("doc_id"), *digest, text.alias("text"))


#: An occurrence of a context: hash of its anchor, digests of its bytes and of its row, its first byte, the place of the
#: anchor in it, its number of windows, and whether it stands for further copies that follow one another.
_ANCHOR = "gram long, same1 long, same2 long, row1 long, row2 long, lo int, at int, windows int, more boolean"
_NAMES = [c.split(" ")[0] for c in _ANCHOR.split(", ")]
_ORDER = ["gram", "same1", "same2", "row1", "row2", "lo"]


def _digests(data: np.ndarray, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows of two halves of the 128-bit digest of each byte range."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(lo.tolist(), stop.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def occurrences(data: np.ndarray, offsets: np.ndarray, window: int, hasher: SpanHasher, chunk: int = _CHUNK_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """The columns of ``_ANCHOR`` but for the row's digest, with ``row`` (its number), a bounded piece of bytes at a time.

    A row of more than ``chunk`` bytes is taken in pieces that share no window start. Of contexts that repeat one after
    another, as in a run of one letter, the first two are listed and one more stands for the others.
    """
    for a, b in slices(offsets, chunk):
        base, size = offsets[a], offsets[b] - offsets[a]
        for start in range(0, max(size - window + 1, 1), chunk) if size > chunk else (0,):
            stop = min(start + chunk + window - 1, size) if size > chunk else size
            piece = data[base + start : base + stop]
            own = np.array([0, len(piece)]) if size > chunk else offsets[a : b + 1] - base
            found = anchors(piece, own, window, hasher)
            row, lo, hi = found["row"], found["lo"], found["hi"]
            same = _digests(piece, lo, hi + window)
            again = np.zeros(len(lo), bool)
            again[1:] = (found["gram"][1:] == found["gram"][:-1]) & (same[1:] == same[:-1]).all(axis=1) & (row[1:] == row[:-1]) & (lo[1:] == hi[:-1] + 1)
            heads = np.flatnonzero(~again)
            nth = np.arange(len(lo)) - np.repeat(heads, np.diff(np.append(heads, len(lo))))
            last = np.repeat(np.append(heads[1:], len(lo)) - 1, np.diff(np.append(heads, len(lo))))
            keep = np.flatnonzero(nth <= 2)
            hi = np.where(nth == 2, hi[last], hi)
            first = own[row] - start
            yield {
                "row": row[keep] + a, "gram": found["gram"][keep].view(np.int64), "same1": same[keep, 0], "same2": same[keep, 1], "lo": (lo - first)[keep].astype(np.int32),
                "at": (found["at"] - lo)[keep].astype(np.int32), "windows": (hi - lo + 1)[keep].astype(np.int32), "more": nth[keep] == 2,
            }


def _find_anchors(docs: DataFrame, window: int, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for found in occurrences(data, offsets, window, hasher, chunk):
                row = pa.array(found.pop("row"))
                found |= {c: batch.column(c).take(row) for c in ("row1", "row2")}
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in _NAMES], _NAMES)

    return _keyed(docs).where(F.octet_length("text") >= window).select("row1", "row2", "text").mapInArrow(run, _ANCHOR)


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """``kind`` and the columns of ``rows`` over partitions sorted by context.

    Of the occurrences of a context the first two of a partition meet as text ('one'), if there are two or the anchor
    has another context; those after them share the verdict ('cover'), and ``sure`` tells that there are such. A lone
    context whose anchor may go on in the next partition is an 'edge', and 'sum' names the partition's first and last
    anchor.
    """

    def settle(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        gram, same1, same2, more = (table.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "same1", "same2", "more"))
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new = new_gram | np.append(True, (same1[1:] != same1[:-1]) | (same2[1:] != same2[:-1]))
        run, group = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        single = ~more
        n = np.bincount(run, single)
        nth = np.cumsum(single) - 1
        nth = nth - (np.cumsum(n) - n).astype(np.int64)[run]
        contexts = np.bincount(group[new])
        meets = (n[run] > 1) | (contexts[group] > 1)
        edge = (first & (group == 0)) | (last & (group == group[-1]))
        further = more | (nth > 1)
        sure = np.bincount(run, further)[run] > 0
        sums = np.flatnonzero(new_gram & edge)
        kinds = (("cover", further), ("one", ~further & meets), ("edge", ~further & ~meets & edge))
        for kind, rows in [*((k, np.flatnonzero(x)) for k, x in kinds), ("sum", sums)]:
            part = table.take(pa.array(rows)).add_column(0, "kind", pa.array([kind] * len(rows), pa.string()))
            yield from part.append_column("sure", pa.array(sure[rows] & (n[run[rows]] > 1))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut or (held and held[-1].column("gram")[-1].as_py() != gram[0]):
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks(), first, False)
                held, first = [], False
            held.append(batch.slice(cut))
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks(), first, True)

    schema = "kind string, " + ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", sure boolean"
    return materialize(rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(run, schema), name)


def _meeting(staged: DataFrame) -> DataFrame:
    """The occurrences that meet as text, those at the edges of partitions included if their anchor goes on."""
    # At most two anchors per partition whatever the input.
    several = staged.where("kind = 'sum'").groupBy(F.col("gram").alias("g")).count().where("count > 1").select("g")
    edges = staged.where("kind = 'edge'").join(F.broadcast(several), F.col("gram") == F.col("g")).drop("g")
    return staged.where("kind = 'one'").union(edges).drop("kind", "more", "same1", "same2")


_SPAN = "row1 long, row2 long, start int, stop int"


def repeated_windows(docs: DataFrame, window: int = WINDOW, group: int = GROUP, chunk: int = _CHUNK_BYTES) -> DataFrame:
    """``row1, row2, start, stop``: runs of window starts (``stop`` included) whose windows occur elsewhere too."""
    whole = ["row1", "row2", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1).alias("stop")]
    # Written first, as finding ranges for the shuffle would otherwise take all anchors twice.
    found, folder = written(_find_anchors(docs, window, chunk), "anchors")
    staged = _dealt(found, "staged")
    discard(docs.sparkSession, folder)
    spans = staged.where("kind = 'cover'").select(*whole)
    texts = materialize(_contexts(docs, _meeting(staged), window), "contexts")
    for width in _WIDTHS:
        full = texts.groupBy(F.col("gram").alias("g")).count().where(F.col("count") > group).select("g").checkpoint()
        many = full.count()
        if not many:
            break
        full = F.broadcast(full) if many <= _BROADCAST else full
        # The contexts of a full anchor are dealt anew, by the bytes that windows of about the same place share.
        hot = texts.join(full, F.col("gram") == F.col("g"), "left_semi")
        spans = spans.union(_by_suffix_array(texts.join(full, F.col("gram") == F.col("g"), "left_anti"), window))
        staged = _dealt(materialize(_pieces(hot, window, width), f"pieces-{width}"), f"staged-{width}")
        spans = spans.union(staged.where("kind = 'cover'").select(*whole))
        texts = _meeting(staged)
    return spans.union(_by_suffix_array(texts, window))


def _contexts(docs: DataFrame, ones: DataFrame, window: int) -> DataFrame:
    """The columns of ``ones``, and the ``bytes`` of each context."""
    own = ["gram", "sure", "lo", "at", "windows"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keys = list(zip(batch.column("row1").to_pylist(), batch.column("row2").to_pylist(), strict=True))
            # Rows of one kind follow one another, and one of them will do.
            fresh = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else before)]
            before = keys[-1] if keys else before
            for lo in range(0, len(fresh), _TEXTS):
                yield pieces(batch.take(pa.array(fresh[lo : lo + _TEXTS], pa.int64())))

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = batch.column("wanted")
        row = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten()
        texts = [_unpack(p) for p in batch.column("packed").to_pylist()]
        lo, windows = flat.field("lo").to_numpy(), flat.field("windows").to_numpy()
        cuts = [texts[r][a : a + w + window - 1] for r, a, w in zip(row.tolist(), lo.tolist(), windows.tolist(), strict=True)]
        take = pa.array(row)
        columns = [*[flat.field(c) for c in own], batch.column("row1").take(take), batch.column("row2").take(take), pa.array(cuts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*own, "row1", "row2", "bytes"])

    wanted = ones.groupBy("row1", "row2").agg(F.collect_list(F.struct(*own)).alias("wanted"))
    rows = _packed(docs).where(F.octet_length("text") >= window).select(F.col("row1").alias("k1"), F.col("row2").alias("k2"), "text")
    packed = rows.mapInArrow(_shrink, "k1 long, k2 long, packed binary")
    joined = wanted.join(packed, (F.col("row1") == F.col("k1")) & (F.col("row2") == F.col("k2"))).select("row1", "row2", "wanted", "packed")
    return joined.mapInArrow(cut, "gram long, sure boolean, lo int, at int, windows int, row1 long, row2 long, bytes binary")


def _packed(docs: DataFrame) -> DataFrame:
    return _keyed(docs).withColumn("text", F.col("text").cast("binary"))


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed, and named ``packed``."""
    for batch in batches:
        packed = pa.array([_pack(t.as_buffer()) for t in batch.columns[-1]], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "packed"])


def _pack(text) -> bytes:
    data = text.to_pybytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pieces(texts: DataFrame, window: int, width: int) -> DataFrame:
    """The windows of contexts by their distance from the anchor, ``width`` distances together, as contexts of a finer
    anchor: the bytes that all windows of these distances hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_NAMES, "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                data, at, windows = row["bytes"], row["at"], row["windows"]
                for cell in range((at - windows + 1) // width, at // width + 1):
                    far, near = min(at, cell * width + width - 1), max(at - windows + 1, cell * width)
                    core = data[at - cell * width : at - (cell * width + width - 1) + window]
                    piece = data[at - far : at - near + window]
                    gram = xxhash.xxh3_64_intdigest(core, seed=cell * 256 + width)
                    same = xxhash.xxh3_128_digest(piece + bytes([far - cell * width, near - cell * width]))
                    halves = [int.from_bytes(x, "little", signed=True) for x in (gram.to_bytes(8, "little"), same[:8], same[8:])]
                    out.append((*halves, row["row1"], row["row2"], row["lo"] + at - far, far, far - near + 1, False, piece))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return texts.mapInArrow(run, _ANCHOR + ", bytes binary")


def _by_suffix_array(texts: DataFrame, window: int) -> DataFrame:
    """The windows of contexts that occur in another context of their anchor, or in another place."""

    def settled(rows: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        own = list(rows.values())
        found, count = [], [0] * len(own)
        for k, a, b in settle([(r[0], r[6], r[4], r[5]) for r in own], window):
            found.append((own[k][1], own[k][2], own[k][3] + a, own[k][3] + b))
            count[k] += b - a + 1
        if wrong := [r for r, n in zip(own, count, strict=True) if r[7] and n != r[5]]:
            raise ValueError(f"contexts of one digest differ: {wrong[0][:4]}")
        if found:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["row1", "row2", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "row1", "row2", "lo", "at", "windows", "bytes", "sure")]
            for row in zip(*columns, strict=True):
                if len(held) >= _BATCH and row[0] != last:
                    yield from settled(held)
                    held = {}
                last = row[0]
                held[row[:4]] = row
        if held:
            yield from settled(held)

    # By a hash of the anchor and not the anchor: else Spark takes the join below for this exchange and may split its groups.
    dealt = texts.repartition(F.xxhash64("gram")).sortWithinPartitions("gram", "row1", "row2", "lo")
    return dealt.mapInArrow(run, _SPAN)


def _apart(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) with one row of each kind, and ``row1, row2, size`` of the kinds that have several.

    Only numbers and digests are shuffled to count the copies, and texts of such kinds alone to find one of each.
    """
    long = _keyed(docs).where(F.octet_length("text") >= window)
    counted = long.groupBy("row1", "row2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
    copies = materialize(counted.where("n > 1").select("row1", "row2", "size"), "copies")
    if copies.isEmpty():
        return docs, copies
    lone = long.join(copies, ["row1", "row2"], "left_anti").select("doc_id", "text")
    return lone.union(long.join(copies, ["row1", "row2"], "left_semi").select("doc_id", "text").distinct()), copies


def _with_spans(docs: DataFrame, window: int, group: int, chunk: int) -> DataFrame:
    """``doc_id, packed, spans`` of every row; rows with copies are one span and meet no others."""
    with scratch(docs.sparkSession, "suffixes") as folder:
        kinds, copies = _apart(docs, window)
        found = repeated_windows(kinds, window, group, chunk)
    gathered = found.groupBy(F.col("row1").alias("k1"), F.col("row2").alias("k2")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialize(gathered, "spans")
    copies = materialize(copies, "copies")
    discard(docs.sparkSession, folder)
    packed = _packed(docs).mapInArrow(_shrink, "doc_id long, row1 long, row2 long, packed binary")
    if copies.isEmpty():
        alike, lone = None, packed
    else:
        alike, lone = (packed.join(copies, ["row1", "row2"], how) for how in ("inner", "left_anti"))
    rows = lone.join(spans, (F.col("row1") == F.col("k1")) & (F.col("row2") == F.col("k2")), "left").select("doc_id", "packed", "spans")
    if alike is None:
        return rows
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("size") - window).alias("stop")))
    return rows.union(alike.select("doc_id", "packed", whole.cast(spans.schema["spans"].dataType).alias("spans")))


def covered(size: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which bytes lie in a window that starts in one of the runs."""
    change = np.zeros(size + 1, np.int64)
    for s in spans or []:
        change[s["start"]] += 1
        change[s["stop"] + window] -= 1
    return np.cumsum(change[:-1]) > 0


def deduplicate(docs: DataFrame, window: int = WINDOW, group: int = GROUP, chunk: int = _CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that are left).

    Rows that repeat are repeats of each other, of the same doc_id or not; a null doc_id stays null. A null or empty
    text, or one under ``window`` bytes, loses nothing. Matches never cross rows, overlaps within a text count, and
    columns other than doc_id and text are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, _TEXTS) for b in batches for lo in range(0, b.num_rows, _TEXTS)):
            rows = []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = _unpack(packed)
                gone = covered(len(text), spans, window)
                kept = text if not spans else np.frombuffer(text, np.uint8)[~gone].tobytes()
                edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
                rows.append((len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _with_spans(docs, window, group, chunk).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
