"""SimHash near-duplicates: 64-bit fingerprints, and a binary-trie self-join under a Hamming budget.

Scale: a fingerprint is a map-side computation; copies collapse onto one row per distinct fingerprint before any
link is searched. The trie of these is cut into subtrees of bounded size, deeper where it is fuller, and a task gets a
subtree together with the codes from others that can still be within the budget when they reach it: each code walks
down the cut beside its own path and spends a bit at every turn. At a depth d and two bits a code visits some
d(d + 1)/4 subtrees, so rows grow with the square of the logarithm of the table. A task holds the codes of one subtree, visitors
pass by in pieces, and it returns a spanning forest of the links it found, never their number squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_LONG, fresh, materialize, quoted, shared_dir, text_or_empty, utf8

SEED = 42
_BLOCK = 1 << 16
#: Codes that a subtree may always hold, subtrees that a cut has at most by its count, and codes that are routed at once.
_LEAST_LEAF = 2_048
_LEAVES = 4_096
_ROUTED = 50_000
#: Up to so many edges (16 bytes each) components are found by one task, beyond by rounds of joins.
FEW_EDGES = 200_000


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of their 64 bits set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The code of which a bit is set if it is in over half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    stops = ends[width - 1 :].tolist()
    digest, seed, counts = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    for lo in range(0, len(stops), _BLOCK):
        pairs = zip(starts[lo : lo + _BLOCK], stops[lo : lo + _BLOCK], strict=False)
        counts += bit_counts(np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64))
    return majority(counts, len(stops))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` per row. A null or blank text has fingerprint 0; repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole, at = data.tobytes(), offsets.tolist()
            fps = [_fingerprint(whole[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Cut:
    """The top of a binary trie of 64-bit codes: children of each inner node (below 0: a leaf's number, less one)."""

    child: np.ndarray

    @staticmethod
    def of(codes: DataFrame, leaf: int | None = None) -> Cut:
        """Cut the trie of the codes ``fp`` so that no subtree below holds more than ``leaf`` of them.

        Counts of the children of nodes that are too full come to the driver eight bits at a time: at most 256 for each
        such node, of which there are no more than codes / leaf. Without ``leaf`` it grows with the table, so that the
        cut has some ``_LEAVES`` leaves whatever the number of codes.
        """
        n = codes.count()
        limit = leaf or max(_LEAST_LEAF, -(-n // _LEAVES))
        full: dict[int, int] = {1: n} if n > limit else {}  # prefixes, led by a one that tells their length
        count = dict(full)
        for depth in range(8, 65, 8):
            if not full:
                break
            prefix = F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")
            above = F.shiftrightunsigned("fp", 72 - depth) if depth > 8 else F.lit(0)
            known = codes if depth == 8 else codes.where(above.isin([p & ~(1 << (depth - 8)) for p in full]))
            held = {(r["p"] % (1 << depth)) | (1 << depth): r["n"] for r in known.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
            for _ in range(8):
                count |= held
                above_held: dict[int, int] = {}
                for p, k in held.items():
                    above_held[p >> 1] = above_held.get(p >> 1, 0) + k
                held = above_held
            full = {p: k for p, k in count.items() if p.bit_length() == depth + 1 and k > limit}
        inner = [p for p, k in count.items() if k > limit and p.bit_length() < 65]
        number = {p: i for i, p in enumerate(sorted(inner))}
        child, leaves = np.zeros((max(len(inner), 1), 2), np.int64), 0
        for p, i in number.items():
            for bit in (0, 1):
                below = 2 * p + bit
                leaves += below not in number
                child[i, bit] = number[below] if below in number else -leaves
        if not inner:
            child[0] = -1  # one leaf; which side a code takes doesn't matter
        return Cut(child)

    @property
    def single(self) -> bool:
        return bool((self.child == -1).all())

    def visits(self, codes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each code, a leaf it is to meet, and the bits by which it is off there (0: its own leaf).

        A code walks down beside its own path, spending a bit wherever it turns off and stopping beyond the budget. Two
        codes of different leaves meet in the leaf of the one that has the first differing bit set.
        """
        row, node, off = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        if self.single:
            return row, node, off
        out = []
        for bit in range(63, -1, -1):
            if not len(row):
                break
            own = ((codes[row] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            turn = (off < budget) & ((off > 0) | (own == 0))
            node = np.concatenate([self.child[node, own], self.child[node[turn], 1 - own[turn]]])
            row, off = np.concatenate([row, row[turn]]), np.concatenate([off, off[turn] + 1])
            done = node < 0
            out.append((row[done], -1 - node[done], off[done]))
            row, node, off = row[~done], node[~done], off[~done]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def trie_join(a: np.ndarray, b: np.ndarray, start: tuple[np.ndarray, ...], bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sorted ``a`` and ``b`` whose codes differ in at most ``budget`` of their low ``bits``.

    A trie node is a range of sorted rows. Pairs of nodes (``start``: ranges of equal higher bits) are walked down
    together one bit at a time; a pair carries the bits by which its sides differ so far and is dropped beyond the
    budget. A pair of single rows is settled by counting the bits that are left. Where ``a`` is ``b``, each pair of
    rows comes once.
    """
    same_side = a is b
    a0, a1, b0, b1, off = start
    if same_side:
        pairs = ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, off = (x[pairs] for x in start)
    low = np.uint64((1 << bits) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(keep: np.ndarray, a0, b0) -> None:
        i, j = a0[keep], b0[keep]
        near = np.bitwise_count((a[i] ^ b[j]) & low) <= budget
        found.append((i[near], j[near]))

    for bit in range(bits - 1, -2, -1):
        alone = (a1 - a0 == 1) & (b1 - b0 == 1)
        settle(alone, a0, b0)
        a0, a1, b0, b1, off = (x[~alone] for x in (a0, a1, b0, b1, off))
        if not len(a0) or bit < 0:
            break
        ones_a = np.concatenate([[0], np.cumsum((a >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        ones_b = ones_a if same_side else np.concatenate([[0], np.cumsum((b >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        # Within a node the higher bits are equal, so its rows with this bit clear stand before those with it set.
        am, bm = a1 - (ones_a[a1] - ones_a[a0]), b1 - (ones_b[b1] - ones_b[b0])
        twice = (a0 == b0) & (a1 == b1) if same_side else np.zeros(len(a0), bool)
        child = [
            (a0, am, b0, bm, off),
            (am, a1, bm, b1, off),
            (a0, am, bm, b1, off + 1),
            (am[~twice], a1[~twice], b0[~twice], bm[~twice], off[~twice] + 1),
        ]
        a0, a1, b0, b1, off = (np.concatenate(x) for x in zip(*child, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (off <= budget)
        if same_side:
            keep &= ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, off = a0[keep], a1[keep], b0[keep], b1[keep], off[keep]
    # Nodes that are left after the last bit hold rows of equal codes; for distinct codes there are none.
    for lo, hi, lo2, hi2 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):
        i, j = np.meshgrid(np.arange(lo, hi), np.arange(lo2, hi2), indexing="ij")
        i, j = (i[i < j], j[i < j]) if same_side and (lo, hi) == (lo2, hi2) else (i.ravel(), j.ravel())
        found.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def trie_self_join(codes: np.ndarray, group: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of equal ``group`` whose ``codes`` differ in at most ``budget`` of their low ``bits``.

    Rows must be sorted by group, then code, and the codes of a group be distinct.
    """
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate([[0], cuts]).astype(np.int64)
    hi = np.concatenate([cuts, [len(codes)]]).astype(np.int64)
    many = hi - lo > 1
    return trie_join(codes, codes, (lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)), bits, budget)


def spanning_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge from each node to the smallest node of its component."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def tree_edges(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs make up a spanning forest: of two that could join the same parts, the one that stands first."""
    nodes, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = both[: len(left)], both[len(left) :]
    label, at, chosen = np.arange(len(nodes)), np.arange(len(left)), []
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.sort(np.concatenate([*chosen, np.zeros(0, np.int64)]))
        first = np.full(len(nodes), len(left))
        np.minimum.at(first, label[a[at]], at)
        np.minimum.at(first, label[b[at]], at)
        pick = np.unique(first[first < len(left)])
        chosen.append(pick)
        node, root = spanning_forest(label[a[pick]], label[b[pick]])
        to = np.arange(len(nodes))
        to[node] = root
        label = to[label]


def links(nodes: DataFrame, budget: int = 2, leaf: int | None = None) -> DataFrame:
    """Edges ``u, v`` between the ids (``rep``) of distinct fingerprints ``fp`` at most ``budget`` bits apart.

    The edges of a task form spanning forests of what it found, so their components are those of all links.
    """
    if budget < 0:
        raise ValueError("a budget is a number of bits")
    cut = Cut.of(nodes, leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            for lo in range(0, len(fp), _ROUTED):
                row, leaf, off = cut.visits(fp[lo : lo + _ROUTED].view(np.uint64), budget)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(off > 0), pa.array(fp[lo + row]), pa.array(rep[lo + row])], ["leaf", "visits", "fp", "rep"])

    def joined(own: tuple, other: tuple) -> Iterator[pa.RecordBatch]:
        (a, a_rep), (b, b_rep) = own, other
        whole = [np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)]
        i, j = trie_join(a, b, tuple(whole), 64, budget)
        if len(i):
            kept = tree_edges(a_rep[i], b_rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(a_rep[i[kept]]), pa.array(b_rep[j[kept]])], ["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leaf, its own codes first: those are held, and visitors pass by in pieces."""
        now, held, own = -1, [], None
        for batch in batches:
            leaf, visits, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((leaf[1:] != leaf[:-1]) | (visits[1:] != visits[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(leaf)], strict=True):
                if lo == hi:
                    continue
                if leaf[lo] != now:
                    if held and own is None:
                        own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                        yield from joined(own, own)
                    now, held, own = leaf[lo], [], None
                piece = (fp[lo:hi].view(np.uint64), rep[lo:hi])
                if not visits[lo]:
                    held.append(piece)
                    continue
                if own is None and held:
                    own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    yield from joined(own, own)
                if own is not None:
                    yield from joined(own, piece)
        if held and own is None:
            own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            yield from joined(own, own)

    routed = nodes.select("fp", "rep").mapInArrow(route, "leaf long, visits boolean, fp long, rep long")
    unsigned = F.col("fp").bitwiseXOR(F.lit(MIN_LONG))  # signed order of it is the unsigned order of fp
    dealt = routed.repartition("leaf").sortWithinPartitions("leaf", "visits", unsigned)
    return dealt.mapInArrow(meet, "u long, v long").distinct()


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``node, component`` (the smallest id reachable) for every node with an edge.

    Up to ``few`` edges go to one task. More are contracted by alternating stars: each round is two grouped minima and
    equi-joins over the edges that are left, cut by checkpoint(); a path of length n takes about log n rounds.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if edges.count() <= few:
        return _components_of_few(edges)
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        down = large.join(low, F.col("u") == F.col("k"))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m")).where("u <> v").distinct()
        edges = small.checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        seen = state


def _components_of_few(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if pairs:
            node, least = spanning_forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
            roots = np.unique(least)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([least, roots]))], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long").checkpoint()


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``; the component is the smallest doc_id reachable.

    Blank texts share fingerprint 0 and link with each other and with whatever is near it. A null doc_id has a
    fingerprint but a null component, and links nothing; rows that repeat a doc_id each get a result. Columns other
    than doc_id and text are ignored, whatever their names. An empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")).checkpoint()
    labels = components(links(nodes, budget))
    known = nodes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("key"), F.coalesce("component", "rep").alias("component"))
    found = fps.join(known, F.col("fp") == F.col("key"), "left")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id, once, where the id repeats.

    Rows with a null doc_id belong to no component and stay.
    """
    found = near_duplicates(docs, width, budget)
    return without_ids(docs, found.where("component_id <> doc_id").select("doc_id").distinct())


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone``, its one column; of the rows of an id that is left, that of the least text hash."""
    left, twice, nth = fresh(docs, "gone", "again", "nth")
    gone = gone.toDF(left)
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col(left), "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice))
    if again.isEmpty():
        return kept
    # Rows of a repeated id are rare, so only they are sorted against each other; a task sends on one row of an id.
    single = kept.join(again, F.col("doc_id") == F.col(twice), "left_anti")
    double = kept.join(again, F.col("doc_id") == F.col(twice), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(text_or_empty()), F.to_json(F.struct(*quoted(*docs.columns))))
    return single.unionByName(double.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth))
