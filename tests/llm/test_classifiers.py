"""The classifiers' features, learners and gradients against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import quality, toxicity
from orogen.llm.common import SpanHasher


def words(text):
    out, run = [], ""
    for c in text + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 128:
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def indices(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])
    row, at = toxicity.features(np.frombuffer(b"".join(data), np.uint8), offsets, SpanHasher())
    return [set(at[row == i].tolist()) for i in range(len(texts))]


_KNOWN: dict[tuple, int] = {}


def feature(kind, *own):
    """The index of one feature, from a text that has few others: word, pair (with words between) or triple."""
    key = (kind, *own)
    if key not in _KNOWN:
        text = " ".join(own) if kind in ("word", "triple") else " ".join([own[0], *["q"] * (kind - 1), own[1]])
        _KNOWN[key] = _single(kind, text)
    return _KNOWN[key]


def _single(kind, text):
    w = text.split()
    h = {x: _hash(x) for x in w}
    mixed = lambda v: int(toxicity.mix(np.array([v % 2**64], np.uint64))[0])
    if kind == "word":
        value = h[w[0]]
    elif kind == "triple":
        value = mixed((h[w[0]] * 3 + h[w[1]]) * 5 + h[w[2]])
    else:
        value = mixed(h[w[0]] * (2 * kind + 1) + (h[w[-1]] ^ kind))
    return value >> (64 - toxicity.BITS)


def _hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    hasher = SpanHasher()
    return int(hasher.spans(hasher.prefix(data), np.array([0]), np.array([len(data)]))[0])


def shingle_features(text):
    """Features of a text as a set: words, pairs up to two words apart, triples."""
    w = words(text)
    out = {feature("word", x) for x in w}
    for gap in (1, 2, 3):
        out |= {feature(gap, a, b) for a, b in zip(w, w[gap:], strict=False)}
    return out | {feature("triple", *x) for x in zip(w, w[1:], w[2:], strict=False)}


def test_features_are_words_pairs_and_triples():
    rng = random.Random(3)
    made = ["", "one", "One two", "a b a b a b", "é, ß! 日本 x", *[" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(30)]]
    assert indices(made) == [shingle_features(t) for t in made]


def test_ftrl_is_the_plain_update():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(120)]
    labels = (rng.random(120) < 0.4).astype(float)
    learner = toxicity.Ftrl(alpha=0.7, beta=1.3, l1=0.4, l2=0.2, epochs=3)
    z, n = [0.0] * 31, [0.0] * 31

    def weight(i):
        l1 = 0.0 if i == 30 else learner.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((learner.beta + math.sqrt(n[i])) / learner.alpha + learner.l2)

    for _ in range(learner.epochs):
        for x, y in zip(rows, labels, strict=True):
            at = [*x.tolist(), 30]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / learner.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    found = learner.fit(rows, labels, 30)
    assert np.allclose(found, [weight(i) for i in range(31)], atol=1e-9)
    assert (found == 0).any() and (found != 0).any()


def plain_forward(model, x):
    """Score of one bag, passage by passage."""
    p = model.p
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    hidden = [np.tanh(((row - model.mean) * model.scale) @ p["W"] + p["b"]) for row in x]
    energy = [float((np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["a"]) for h in hidden]
    share = np.exp(np.array(energy) - max(energy))
    pooled = sum(s * h for s, h in zip(share / share.sum(), hidden, strict=True))
    return float(sigmoid(pooled @ p["c"] + p["d"][0]))


@pytest.fixture(scope="module")
def bags():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(17, 6))
    start = np.array([0, 1, 5, 9, 10])
    model = quality.AttentionModel.new(x.mean(axis=0), 1 / x.std(axis=0), hidden=5, gate=3)
    return model, x, start, np.array([1.0, 0.0, 0.0, 1.0, 1.0])


def test_attention_weighs_passages(bags):
    model, x, start, _ = bags
    got = model.forward(x, start)
    assert np.allclose(got["y"], [plain_forward(model, b) for b in np.split(x, start[1:])])
    assert np.allclose(np.add.reduceat(got["w"], start), 1)


def test_gradient_is_that_of_the_loss(bags):
    model, x, start, y = bags

    def loss():
        p = model.forward(x, start)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = model.gradient(model.forward(x, start), y, start)
    for name, value in model.p.items():
        flat, slope = value.reshape(-1), np.zeros(value.size)
        for i in range(value.size):
            for sign in (1, -1):
                flat[i] += sign * 1e-6
                slope[i] += sign * loss()
                flat[i] -= sign * 1e-6
        assert np.allclose(got[name].reshape(-1), slope / 2e-6, atol=1e-7), name


def test_passages_hold_every_word():
    text = " ".join(f"w{i}" for i in range(200)) + " end!"
    data = np.frombuffer(text.encode(), np.uint8)
    x, owner = quality.passages(data, np.array([0, len(data)]), SpanHasher())
    assert len(x) == math.ceil(201 / quality.PASSAGE) and (owner == 0).all()
    share = [text.encode()[i] for i in range(len(text))]
    spaces = sum(b == 32 for b in share)
    assert x[:, 0].sum() > 0 and spaces == 200
    # The mean length of the words of the first passage.
    first = text.split()[: quality.PASSAGE]
    assert math.isclose(x[0, len(quality._OWN) + 5] * 8, sum(map(len, first)) / len(first), rel_tol=1e-5)


@pytest.mark.parametrize("limit", [0, 400, 10**9])
def test_sample_is_bounded_in_bytes(spark, documents, limit):
    docs = documents([(i, "x" * (10 * i)) for i in range(1, 30)])
    ids = spark.createDataFrame([(i, 1) for i in range(1, 30)], "id long, y int")
    order = [r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").collect()]
    expected, total = set(), 0
    for i in order:
        total += 10 * i
        if not expected or total <= limit:
            expected.add(i)
    assert {r["id"] for r in toxicity.sampled_texts(docs, ids, limit).collect()} == expected
