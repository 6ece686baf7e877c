"""Spelling variants against edit distances by dynamic programming, odd rows included."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orogen.llm import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def grouped(words, least=4):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and min(len(v), len(w)) >= least and distance(v, w) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def check(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.group(table, **options).collect()} == grouped(words)


@pytest.mark.parametrize("shard", [3, 50_000])
def test_random_words(spark, shard):
    random.seed(13)
    words = {}
    for alphabet, size, count in (("abé", 9, 120), ("abcdefÿ", 7, 120), ("xy", 30, 40)):
        for _ in range(count):
            base = "".join(random.choice(alphabet) for _ in range(random.randint(1, size)))
            for _ in range(3):
                k = random.randrange(len(base))
                base = random.choice([base[:k] + base[k + 1 :], base[:k] + random.choice(alphabet) + base[k:], base[:k] + random.choice(alphabet) + base[k + 1 :]]) or "a"
                words[base] = random.choice([1, 2, 3, 4, 6, 8, 12, 100])
    check(spark, words, shard=shard)


def test_hot_halves(spark):
    """Hundreds of words share a half, a length and most of the other half."""
    random.seed(14)
    words = {"stem" * 3 + "".join(random.choice("abc") for _ in range(random.randint(5, 6))): random.randint(1, 50) for _ in range(250)}
    words |= {"".join(random.choice("abc") for _ in range(5)) + "tail" * 3: random.randint(1, 50) for _ in range(150)}
    check(spark, words, shard=40)


def test_long_chains(spark):
    words = {"aaaa" + "b" * k + "c" * (12 - k): 2**k for k in range(13)}
    check(spark, words)


def test_one_edit():
    random.seed(15)
    for _ in range(3000):
        a, b = ("".join(random.choice("ab") for _ in range(random.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_words_of_odd_rows(odd):
    expected = Counter()
    for r in odd.collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            k = h % len(run)
            expected[run[:k] + run[k + 1 :] if h % 7 == 0 else run] += 1
    counted = spelling.count_words(spelling.with_slips(spelling.runs_of(odd), 7), 4, 2)
    assert {tuple(r) for r in counted.collect()} == {(w, n) for w, n in expected.items() if len(w) >= 4 and n >= 2}


def test_empty_null_and_extra_columns(spark, odd):
    assert spelling.group(spelling.count_words(spelling.runs_of(odd.limit(0)))).count() == 0
    words = spark.createDataFrame([(None, 9, "x"), ("", 9, "x"), ("word", 2, "x"), ("ward", 4, "y"), ("wor", 50, "z")], "word string, n int, root string").withColumn("a.b", F.lit(1))
    assert {tuple(r) for r in spelling.group(words).collect()} == {("", None, "", 9, 0, None), ("word", "ward", "ward", 2, 1, 4), ("ward", None, "ward", 4, 1, None), ("wor", None, "wor", 50, 0, None)}
    with pytest.raises(ValueError):
        spelling.group(words, least_ratio=1)
