"""The near-duplicate stage of the pipeline against brute force over all pairs, on planted edits and odd rows."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from orogen.llm import near_copies
from orogen.llm.common import SpanHasher


def shingles(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) > width else {tuple(w)}


def survivors(docs):
    """Least ids of the components of all pairs with a five-word Jaccard similarity of 0.8 or more."""
    sets = [(i, shingles(t or "")) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return sorted({root(i) for i, _ in sets})


@pytest.fixture(scope="module")
def edited():
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(500)] + ["É", "Ab"]
    boilerplate = [random.choice(vocabulary) for _ in range(40)]
    made, ids = [], iter(random.sample(range(100, 10_000), 2_000))
    for size in (3, 6, 12, 40, 150, 700):
        for _ in range(8):
            base = [random.choice(vocabulary) for _ in range(size)] + boilerplate * random.randint(0, 1)
            made.append((next(ids), " ".join(base)))
            for _ in range(4):  # from single edits to more than a similarity of 0.8 allows
                t = base[:]
                for _ in range(random.randint(0, 1 + len(t) // 25)):
                    at = random.randrange(len(t))
                    t[at : at + random.randint(0, 1)] = random.choice([["edited"], [], ["two", "words"]])
                made.append((next(ids), random.choice([" ", "\n", " \t"]).join(t).swapcase().lower().upper()))
    hot = [random.choice(vocabulary) for _ in range(120)]
    made += [(next(ids), " ".join("x" if k == i % 120 else w for k, w in enumerate(hot))) for i in range(150)]
    # Four of five and three of five shingles in common: at the limit, and under it.
    made += [(20, "a b c d e f g h i"), (21, "a b c d e f g h"), (22, "k l m n o p q r"), (23, "k l m n o p q"), (24, "s t u v w"), (25, "S T  U V W"), (26, "s t u v")]
    return made


def test_stage_drops_every_near_copy(spark, documents, odd, edited):
    docs = documents(edited).union(odd)
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "")
    assert found.columns == docs.columns
    kept = Counter(r["doc_id"] for r in found.collect())
    assert kept.pop(None) == 1
    assert sorted(kept.elements()) == survivors(every)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("sample", [1, 10_000])
def test_links_do_not_depend_on_the_sample(spark, documents, edited, monkeypatch, sample):
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", sample)
    docs = documents(edited)
    assert sorted(r["doc_id"] for r in near_copies.without_near_copies(docs).collect()) == survivors(edited)


@pytest.mark.parametrize(("block", "few"), [(20, 200_000), (2_000, 0)])
def test_links_do_not_depend_on_blocks_and_bounds(spark, documents, edited, monkeypatch, block, few):
    monkeypatch.setattr(near_copies.thinned, "__defaults__", (few,))
    docs = documents(edited)
    assert sorted(r["doc_id"] for r in near_copies.without_near_copies(docs, block=block).collect()) == survivors(edited)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3_000, rng.integers(1, 2_500)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        apart = len(np.setxor1d(a, b))
        for bits in (near_copies.PARITY, 8 * near_copies.PARITY):
            x, y = (np.frombuffer(near_copies.parity_sketch(s, bits), np.uint8) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= apart
        assert near_copies.folded(near_copies.parity_sketch(a, 4 * near_copies.PARITY), near_copies.PARITY // 8).tobytes() == near_copies.parity_sketch(a, near_copies.PARITY)


def test_hashes_are_those_of_the_shingles():
    made = ["", " \t", "a", "a b c d", "a b c d e", "A  b c d e f a b c d e", "é ü\nx y z w"]
    data = [t.encode() for t in made]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    owner, h = near_copies.shingle_hashes(np.frombuffer(b"".join(data), np.uint8), offsets, 5, SpanHasher())
    named = {}
    for row, text in enumerate(data):
        own = set(h[owner == row].tolist())
        assert len(own) == len(near_copies.shingles(text, 5))
        for other, seen in named.items():
            assert len(own & seen[0]) == len(near_copies.shingles(text, 5) & seen[1]), other
        named[text] = (own, near_copies.shingles(text, 5))
