"""Edit-embedding fingerprints against a walk step by step, odd rows included."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import edit_prints as ep
from orogen.llm.edit_prints import Print


def embedded(text, walk):
    """One coordinate a step, moving on where the random bit of step and class says so."""
    bits, out, i, j = ep.move_bits(walk), [], 0, 0
    classes = ep.classes_of(np.array([ord(c) for c in text], np.uint32)).tolist()
    while i < len(text):
        out.append(ord(text[i]))
        i += int(bits[j % ep.PERIOD, classes[i]])
        j += 1
    return out


def plain_print(text):
    parts = []
    for walk in range(ep.WALKS):
        e = embedded(text, walk)
        level, blocks = 0, -(-len(e) // ep.BLOCK)
        while blocks > ep.SAMPLES:
            level, blocks = level + 1, -(-blocks // 2)
        window = np.zeros((blocks, ep.WIDTH), np.uint64)
        for b in range(blocks):
            start = int(ep.sample_steps(level, np.array([b]))[0])
            for k, c in enumerate(e[start : start + ep.WIDTH]):
                window[b, k] = c + 1
        parts.append((level, ep._sample_bytes(window).tobytes()))
    return Print(tuple(parts)).packed().hex()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("lanes", [1, 32])
def test_prints_are_those_of_single_steps(lanes, monkeypatch):
    monkeypatch.setattr(ep, "_LANES", lanes)
    random.seed(11)
    texts = ["", "a", "", "é\U0001f600"] + ["".join(random.choice("abcdé \U0001f600") for _ in range(random.choice([1, 30, 700, 6000]))) for _ in range(50)]
    assert [p.packed().hex() for p in ep.prints_of(texts)] == [plain_print(t) for t in texts]
    assert ep.prints_of([]) == []


def test_samples_of_long_blocks_are_among_those_of_short_ones():
    for level in range(1, 6):
        fine = set(ep.sample_steps(level - 1, np.arange(256)).tolist())
        steps = ep.sample_steps(level, np.arange(128))
        assert set(steps.tolist()) <= fine and (steps // (ep.BLOCK << level) == np.arange(128)).all()


def test_likeness_falls_with_edits():
    random.seed(12)
    text = "".join(random.choice("abcdefghijklmnop ") for _ in range(5000))
    own = ep.prints_of([text])[0]
    before = 1.0
    for edits, least in ((0, 1.0), (5, 0.8), (50, 0.3), (5000, 0.0)):
        mean = 0.0
        for _ in range(10):
            t = list(text)
            for _ in range(edits):
                k = random.randrange(len(t))
                t[k : k + 1] = random.choice([[], [t[k], "x"], [random.choice("abcdefghijklmnop")]])
            mean += ep.compare(own, ep.prints_of(["".join(t)])[0])[0]
        mean /= 10
        assert least <= mean <= before
        before = mean
    assert before < 0.05
    halves = [ep.compare(own, ep.prints_of([ep.edited(text, text[k : k + 3000][::-1])])[0])[0] for k in range(0, 2000, 200)]
    assert all(0.4 < h < 0.6 for h in halves)


def followed(rows):
    """Rows in order of doc_id (null first); rows of one doc_id come in any order, so they must have equal texts here."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = ep.prints_of([t for _, t in rows])
    out = []
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        new = ep.edited(t, rows[n][1])
        of_new = ep.prints_of([new])[0]
        (near_new, met_new), (near_next, met_next) = ep.compare(prints[k], of_new), ep.compare(prints[k], prints[n])
        out.append((i, len(t), sha(new), prints[k].packed().hex(), of_new.packed().hex(), near_new, near_next, met_new, met_next))
    return sorted(out, key=repr)


def test_against_next(odd, documents):
    assert sorted(map(tuple, ep.against_next(odd).collect()), key=repr) == followed([(r["doc_id"], r["text"]) for r in odd.collect()])
    random.seed(13)
    rows = [(random.randrange(10**6), "".join(random.choice("ab é") for _ in range(random.choice([0, 1, 5, 400])))) for _ in range(300)]
    rows += [(7, "same row")] * 40 + [(None, None)] * 3
    found = sorted(map(tuple, ep.against_next(documents(rows).repartition(7)).collect()), key=repr)
    assert found == followed(rows)


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_rows(documents, count):
    rows = [(5, "one text"), (6, "another text")][:count]
    docs = documents(rows + [(0, "x")]).where("doc_id > 0")
    assert sorted(map(tuple, ep.against_next(docs).collect()), key=repr) == (followed(rows) if rows else [])


def test_fingerprints_keep_columns(odd):
    docs = odd.withColumn("fingerprint", F.lit("old")).withColumn("a.b", F.lit(1))
    made = ep.fingerprints(docs)
    assert set(made.columns) == set(docs.columns)
    found = made.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "fingerprint", "`a.b`").collect()
    assert len(found) == odd.count() and all(r["a.b"] == 1 for r in found)
    assert all(r["fingerprint"] == ep.prints_of([r["t"]])[0].packed().hex() for r in found)


def test_search_finds_every_near_text(documents):
    random.seed(14)
    header = " ".join(random.choice("abcdefgh") * 3 for _ in range(40))
    base = ["".join(random.choice("abcdefghijklmnop ") for _ in range(random.randint(300, 900))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 6)):
            k = random.randrange(len(t))
            t[k : k + 1] = random.choice([[], [t[k], "x"], ["y"]])
        rows.append((i, (header if i % 3 == 0 else "") + "".join(t)))
    rows += [(200, None), (201, ""), (202, ""), (None, base[0]), (203, rows[0][1])]
    docs = documents(rows)
    found = {tuple(r) for r in ep.search(docs, docs.where("doc_id % 5 = 0"), least=0.25, max_edits=0.05).collect()}

    def within(a, b, most):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
            if min(row) > most:
                return None
        return row[-1] if row[-1] <= most else None

    known = [(i, t) for i, t in rows if i is not None and t is not None]
    expected = set()
    for i, a in known:
        for j, b in known if i % 5 == 0 else []:
            if abs(len(a) - len(b)) <= (most := int(max(len(a), len(b)) * 0.05)) and (d := within(a, b, most)) is not None:
                expected.add((i, j, d))
    assert found <= expected and len(found) >= 0.97 * len(expected) and len(expected) > 150
    assert ep.search(docs.limit(0), docs).count() == 0 and ep.search(docs, docs.limit(0)).count() == 0
