"""Near copies: every pair of documents whose sets of word shingles have a Jaccard similarity of ``least`` or more.

A bit budget on SimHash codes can't promise that: at a similarity of 0.8 codes lie some ten bits apart, with a wide
spread. So the links of the SimHash trie self-join are candidates, and so are pairs that share a shingle of their
prefixes: with shingles in one fixed order, the first ``n - ceil(least * n) + 1`` of a document hold the first one that
a near copy shares with it. Pairs of the second kind must also have parity sketches that are near enough: a shingle
that only one side holds turns over one bit of the sketch, so the bits that differ are never more than such shingles.
Neither filter loses a near copy. What passes is compared by sketches as long as the texts, which bound it likewise,
and confirmed on the words themselves.

Scale: about a fifth of the shingles is shuffled once, as hashes, range-partitioned down to the document so that no
shingle is too frequent for a task; those that one document alone holds are dropped. Frequent shingles, known from a
sample, come last in the order and so are seldom in a prefix. Documents of equal shingle sets go on as one. Documents
that share a shingle are compared by their sketches of ``PARITY`` bits in blocks of ``BLOCK``, which spreads a frequent
one over many tasks (a shingle of s documents costs s * s comparisons of sketches, but no row for a pair): a task
returns a spanning forest of what it found. Only where an edge of a forest isn't confirmed are the documents of its
tree compared again, and then every pair that passes the filters between different components is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, SpanHasher, byte_class, discard, lean, materialize, mix, scratch, shared_dir, slices, text_or_empty, utf8, word_spans
from .simhash import FEW_EDGES, bit_counts, components, links, majority, tree_edges, without_ids

SAMPLE_DOCS = 10_000
MAX_FREQUENT = 100_000
PARITY = 1_024
BLOCK = 2_000
BUDGET = 2
_CHUNK_BYTES = 300_000
_TEXTS = 200
_HELD = 50_000
_PAIRS = 200_000
_SLOTS = 1 << 24
_TOKEN = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
_EPS = 1e-9


def shingles(text: bytes, width: int) -> set[bytes]:
    """Runs of ``width`` words; a shorter text is one run of all its words, a blank one the empty run."""
    words = text.lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))}


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each of ``shingles``, repeats included."""
    lower = ASCII_LOWER[data]
    start, end, rows = word_spans(lower, offsets, _TOKEN)
    h = np.concatenate([hasher.spans(hasher.prefix(lower), start, end), np.zeros(width, np.uint64)])
    size = np.maximum(np.diff(rows) - width + 1, 1)
    owner = np.repeat(np.arange(len(size)), size)
    at = rows[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    stop, out = rows[1:][owner], np.zeros(len(owner), np.uint64)
    for j in range(width):
        word = np.where(at + j < stop, h[np.minimum(at + j, len(h) - 1)], np.uint64(0))
        out = mix((out + word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return owner, out.view(np.int64)


def ordered(h: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shingle hashes as numbers in the order of the prefixes: the logarithm of the frequency, then 58 bits of the hash."""
    rank = np.zeros(len(h), np.uint64)
    if len(known):
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[place] == h, weight[place], 0).astype(np.uint64)
    return (rank << np.uint64(58)) | (h.view(np.uint64) >> np.uint64(6))


def prefix_size(size: int, least: float) -> int:
    return min(size - int(np.ceil(least * size - _EPS)) + 1, size)


def parity_sketch(shingles: np.ndarray, bits: int) -> bytes:
    """A bit for each remainder of the shingles: whether an odd number of them has it."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide(size: int) -> int:
    """Bits of a sketch for the pairs that are left: as many as shingles, rounded up to a power of two."""
    return max(PARITY, 1 << (size - 1).bit_length())


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes that a wider one contains."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


_PROFILE = "node long, size int, set1 long, set2 long, fp long, parity binary, wide binary, tokens array<long>"


def profiles(docs: DataFrame, width: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of ``docs`` (node, text): the number of its shingles, a 128-bit hash of their set, their SimHash code and
    parity sketches, and the shingles of its prefix."""
    known, weight = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                owner, h = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, hasher)
                key, cuts = ordered(h, known, weight), np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
                sizes, sets, codes, parities, wides, tokens = [], [], [], [], [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    own = np.unique(key[a:b])
                    sizes.append(len(own))
                    sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                    codes.append(majority(bit_counts(h[a:b].view(np.uint64)), b - a))
                    parities.append(parity_sketch(own, PARITY))
                    wides.append(parity_sketch(own, wide(len(own))))
                    tokens.append(own[: prefix_size(len(own), least)].view(np.int64))
                pair = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, tokens)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
                columns = [batch.column("node").slice(lo, hi - lo), pa.array(sizes, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(parities, pa.binary()), pa.array(wides, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "set1", "set2", "fp", "parity", "wide", "tokens"])

    return docs.mapInArrow(lean(run), _PROFILE)


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of at most ``MAX_FREQUENT`` shingles met most often in a sample of ids.

    They only set the order of the prefixes; the links don't depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                owner, h = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width, hasher)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                yield pa.RecordBatch.from_arrays([pa.array(h[np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))])], ["token"])

    every = max(docs.count() // SAMPLE_DOCS, 1)
    sample = docs.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    held = sample.mapInArrow(lean(run), "token long")
    top = held.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).toArrow()
    token, count = (top.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    return token[order], np.minimum(np.log2(np.maximum(count[order], 1)), 62).astype(np.int64) + 1


def shared_tokens(sets: DataFrame) -> DataFrame:
    """``token, node`` of prefix shingles that several sets hold; a shingle at the edge of a partition stays in any case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, None  # the shingle of the last row, and that row while it hasn't met its equal
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            keep = np.zeros(len(token), bool)
            same = token[1:] == token[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before is None or before == token[0]
            if waiting is not None and before == token[0]:
                yield waiting
            yield batch.filter(pa.array(keep))
            before, waiting = token[-1], None if keep[-1] else batch.slice(len(token) - 1)
        if waiting is not None:
            yield waiting

    tokens = sets.select(F.explode("tokens").alias("token"), "node")
    return tokens.repartitionByRange("token", "node").sortWithinPartitions("token", "node").mapInArrow(lean(run), "token long, node long")


def dealt_to_blocks(shared: DataFrame, block: int) -> DataFrame:
    """``token, low, high, second, node``: the documents of a shingle in blocks of some ``block``, a row for every block
    that its own block meets, and whether its own is the second of the two."""
    many = shared.groupBy(F.col("token").alias("full")).count().where(F.col("count") > block)
    many = many.select("full", F.ceil(F.col("count") / block).cast("int").alias("blocks")).checkpoint()
    side = F.broadcast(many) if many.count() <= MAX_FREQUENT else many
    own = shared.join(side, F.col("token") == F.col("full"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("second"), "node")


def close_pairs(blocks: DataFrame, sketches: DataFrame, least: float, across: bool) -> DataFrame:
    """``u, v, apart``: pairs of nodes that meet in a block, are near enough in size and sketch and have different labels.

    ``sketches`` has ``node, size, parity, label``. All pairs (``across``), or per task a spanning forest of the nearest.
    """
    share = (1 - least) / (1 + least)

    def near(size: np.ndarray, parity: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((size[i] >= least * size[j] - _EPS) & (size[j] >= least * size[i] - _EPS))
        apart = np.ones(len(i))
        for lo in range(0, len(at), _PAIRS):
            k = at[lo : lo + _PAIRS]
            odd = np.bitwise_count(parity[i[k]] ^ parity[j[k]]).sum(axis=1, dtype=np.int64)
            apart[k] = odd / (size[i[k]] + size[j[k]])
        return apart <= share + _EPS, apart

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, low, high, second, node, size, label = (table.column(c).to_numpy() for c in ("token", "low", "high", "second", "node", "size", "label"))
        parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(node), -1)
        found: list[tuple[np.ndarray, ...]] = []
        i, gap = np.arange(len(node)), 1
        while True:
            i = i[i + gap < len(node)]
            j = i + gap
            i = i[(token[i] == token[j]) & (low[i] == low[j]) & (high[i] == high[j])]
            if not len(i):
                break
            j = i + gap
            meet = (label[i] != label[j]) & ((low[i] == high[i]) | (second[i] != second[j]))
            a, b = i[meet], j[meet]
            good, apart = near(size, parity, a, b)
            a, b = node[a[good]], node[b[good]]
            found.append((np.maximum(a, b), np.minimum(a, b), apart[good]))
            if sum(len(x[0]) for x in found) > _PAIRS:
                found = [_thinned(found, across)]
            gap += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _thinned(found, across)], ["u", "v", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _HELD:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = np.stack([table.column(c).to_numpy() for c in ("token", "low", "high")])
            other = np.flatnonzero((group != group[:, -1:]).any(axis=0))
            if len(other):
                cut = int(other[-1]) + 1
                yield from compared(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held).combine_chunks())

    rows = blocks.join(sketches, "node").select("token", "low", "high", "second", "node", "size", "parity", "label")
    dealt = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "second", "node")
    return dealt.mapInArrow(lean(run), _EDGE).groupBy("u", "v").agg(F.min("apart").alias("apart"))


_EDGE = "u long, v long, apart double"


def _thinned(found: list[tuple[np.ndarray, ...]], every: bool) -> tuple[np.ndarray, ...]:
    """Each pair once, or those of a spanning forest that takes the nearest pairs first."""
    u, v, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((v, u, apart))
    u, v, apart = u[order], v[order], apart[order]
    kept = np.unique(np.stack([u, v]), axis=1, return_index=True)[1] if every and len(u) else tree_edges(u, v)
    return u[kept], v[kept], apart[kept]


def thinned(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``u, v`` of a spanning forest of the nearest ``edges``, where they are few enough for a task; else all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in ("u", "v", "apart")) for b in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _thinned(held, False)], ["u", "v", "apart"])

    edges = materialize(edges, "edges")
    return materialize(edges.repartition(1).mapInArrow(lean(run), _EDGE), "forest") if edges.count() <= few else edges


def likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``u, v`` of ``pairs`` that may be near copies by their wide sketches."""
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("wide_u", "wide_v", "size_u", "size_v")], strict=True)
            good = []
            for a, b, m, n in rows:
                size = min(len(a), len(b))
                odd = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
                good.append(odd <= share * (m + n) + _EPS and m >= least * n - _EPS and n >= least * m - _EPS)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "size_u", "size_v", "wide_u", "wide_v").mapInArrow(lean(run), "u long, v long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """The ``u, v`` of ``pairs`` with rows in ``docs`` (``node, text``) that are near copies, by the words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, _TEXTS) for b in batches for lo in range(0, b.num_rows, _TEXTS)):
            sides = []
            for name in ("a", "b"):
                data, offsets = utf8(batch.column(name))
                sides.append((data.tobytes(), offsets.tolist()))
            (a, at), (b, bt) = sides
            near, last, left = [], None, set()
            for i in range(batch.num_rows):
                text = b[bt[i] : bt[i + 1]]
                if text != last:
                    last, left = text, shingles(text, width)
                right = shingles(a[at[i] : at[i + 1]], width)
                both = len(left & right)
                near.append(both >= least * (len(left) + len(right) - both) - _EPS)
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    needed = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    # Texts whose hash no candidate has are left where they are; the bitmap is at most _SLOTS bits whatever the input.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_SLOTS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))")
    bitmap = needed.select(F.floor(slot("id") / 64).alias("word"), bit("id").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    maybe = docs.join(F.broadcast(bitmap), F.floor(slot("node") / 64) == F.col("word")).where(F.col("bits").bitwiseAND(bit("node")) != 0).select("node", "text")
    left = maybe.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("other")), "node")
    both = left.select(F.col("node").alias("u"), F.col("text").alias("a"), F.col("other").alias("v")).join(maybe.toDF("r", "b"), F.col("v") == F.col("r"))
    return materialize(both.select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long").distinct(), "confirmed")


def near_links(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` between ids whose components are those of all pairs of near copies."""
    if not 0 < least <= 1:
        raise ValueError("a least similarity lies above 0 and at most at 1")
    shared_dir(docs.sparkSession)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))
    held = materialize(profiles(docs, width, least, frequent_shingles(docs, width)), "profiles")
    one = held.groupBy("set1", "set2").agg(F.min("node").alias("node"), F.min_by(F.struct("size", "fp", "parity", "wide", "tokens"), "node").alias("s"))
    sets = materialize(one.select("set1", "set2", "node", "s.*"), "sets")
    first = sets.select(F.col("set1").alias("k1"), F.col("set2").alias("k2"), F.col("node").alias("v"))
    same = held.select(F.col("node").alias("u"), "set1", "set2").join(first, (F.col("set1") == F.col("k1")) & (F.col("set2") == F.col("k2"))).where("u <> v").select("u", "v")
    codes = sets.groupBy("fp").agg(F.min("node").alias("rep")).checkpoint()
    alike = sets.select("node", "fp").join(codes, "fp").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    blocks = materialize(dealt_to_blocks(materialize(shared_tokens(sets), "shared"), block), "blocks")
    # An id that several rows have may have several sets; all of them stand for it.
    sketches = sets.select("node", "size", "parity")
    forest = close_pairs(blocks, sketches.withColumn("label", F.col("node")), least, across=False)
    by_code = links(codes, BUDGET).union(alike).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    tried = thinned(forest.union(by_code.withColumn("apart", F.lit(1.0)))).select("u", "v")
    good = confirmed(materialize(likely(tried, sets, least), "likely"), docs, width, least)
    refuted = tried.join(good, ["u", "v"], "left_anti")
    if refuted.isEmpty():
        return same.union(good)
    # The trees that hold a refuted edge: there, pairs that pass the filters may link what the forest left apart.
    trees = components(tried)
    bad = refuted.join(trees, F.col("u") == F.col("node")).select(F.col("component").alias("tree")).distinct()
    labels = components(good).select(F.col("node").alias("known"), "component")
    again = trees.join(bad, F.col("component") == F.col("tree"), "left_semi").select(F.col("node").alias("id"))
    again = again.join(labels, F.col("id") == F.col("known"), "left").select("id", F.coalesce("component", "id").alias("label"))
    redo = sketches.join(again, F.col("node") == F.col("id")).select("node", "size", "parity", "label")
    rest = close_pairs(blocks, redo, least, across=True).select("u", "v").join(tried, ["u", "v"], "left_anti")
    return same.union(good).union(confirmed(materialize(likely(rest, sets, least), "rest"), docs, width, least))


def without_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest doc_id, once, where the id repeats.

    Words are parted by ASCII whitespace and compared without ASCII case. Texts of fewer than ``width`` words are near
    copies if equal, blank and null ones of each other. Rows that repeat a doc_id are one document, near to another if
    any of its rows is. Rows with a null doc_id are in no group and stay.
    """
    with scratch(docs.sparkSession, "near-copies") as folder:
        labels = components(near_links(docs, width, least, block))
    discard(docs.sparkSession, folder)  # the labels are checkpointed
    return without_ids(docs, labels.where("node <> component").select("node").distinct())
