"""Spelling variants: words one edit apart, found by automata over word halves, and the commonest form of each.

One edit leaves one half of a word intact, the first at the start of the other word or the second at its end. So
Aho-Corasick automata hold both halves of every word, and every word is scanned by the automata that can hold a half
of it. What matches at the right end and has a length within one of the word's own is verified. Automata are sharded by
the two outer characters of a half; a shard of more than ``SHARD`` halves is cut into parts by the hash of the word, and
the words that concern it are scanned by each part. A scan answers one row per word, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty, written

#: Latin letters, U+00C0 to U+00FF included.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Halves in one automaton, on average at most.
SHARD = 50_000
#: Pairs of outer characters up to which their table goes to every task.
FEW_PAIRS = 100_000
#: Words that share a half and a length, up to which each is verified on its own.
FEW = 16
#: Words shorter than this have halves of one character, and no near words here.
LEAST_CHARS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCANNED = "word string, n_near long, near_n long, near string"


def runs_of(docs: DataFrame, pattern: str = LETTERS) -> DataFrame:
    """``doc_id, run``: every maximal run of ``pattern`` in every text, A-Z lower-cased; null texts have none."""
    runs = F.regexp_extract_all(text_or_empty(), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.explode(runs).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def with_slips(runs: DataFrame, every: int) -> DataFrame:
    """The runs, where ``every`` divides the crc32 of ``<doc_id>:<run>`` without one of their characters (a null doc_id
    counts as an empty text). Such slips are planted so that variants of known origin can be counted."""
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"), "UTF-8"))
    at = (F.col("__h") % F.length("run")).cast("int")
    run = F.col("run")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length("run")))
    return runs.withColumn("__h", h).withColumn("run", F.when(F.col("__h") % every == 0, cut).otherwise(run)).drop("__h")


def count_words(runs: DataFrame, min_chars: int = 5, min_n: int = 3) -> DataFrame:
    """``word, n``: distinct runs of at least ``min_chars`` code points that occur at least ``min_n`` times."""
    long = runs.where(F.length("run") >= min_chars)
    return long.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)


class _Node:
    """Words of one length without what they share, found again by what is left of a word near them."""

    def __init__(self, entries: list[tuple[str, str, int]]) -> None:
        self.entries = entries
        self.ahead: dict[str, _Node] | None = None
        self.behind: dict[str, _Node] | None = None

    def _split(self) -> None:
        ahead: dict[str, list] = {}
        behind: dict[str, list] = {}
        for rest, word, n in self.entries:
            half = len(rest) // 2
            ahead.setdefault(rest[:half], []).append((rest[half:], word, n))
            behind.setdefault(rest[half:], []).append((rest[:half], word, n))
        self.ahead = {k: _Node(v) for k, v in ahead.items()}
        self.behind = {k: _Node(v) for k, v in behind.items()}

    def near(self, rest: str, found: dict[str, int]) -> None:
        """Add the words whose rest is one edit from ``rest``."""
        size = len(self.entries[0][0])
        if len(self.entries) <= FEW or size < 2:
            for own, word, n in self.entries:
                if one_edit(own, rest):
                    found[word] = n
            return
        if self.ahead is None:
            self._split()
        half = size // 2
        if (node := self.ahead.get(rest[:half])) is not None:
            node.near(rest[half:], found)
        cut = len(rest) - (size - half)
        if cut >= 0 and (node := self.behind.get(rest[cut:])) is not None:
            node.near(rest[:cut], found)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Shard:
    """An automaton over the halves of words that lie at one end, with the words of each half by length."""

    def __init__(self, at_end: bool, words: list[tuple[str, int]]) -> None:
        self.at_end = at_end
        halves: dict[str, dict[int, list]] = {}
        for word, n in words:
            cut = len(word) // 2
            half, rest = (word[cut:], word[:cut]) if at_end else (word[:cut], word[cut:])
            halves.setdefault(half, {}).setdefault(len(word), []).append((rest, word, n))
        self.automaton = ahocorasick.Automaton()
        for half, by_length in halves.items():
            self.automaton.add_word(half, (len(half), {length: _Node(entries) for length, entries in by_length.items()}))
        self.automaton.make_automaton()

    def near(self, word: str) -> dict[str, int]:
        """Words one edit from ``word`` that share their half at this shard's end, but not those at both ends twice."""
        found: dict[str, int] = {}
        for end, (size, by_length) in self.automaton.iter(word):
            if end != (len(word) if self.at_end else size) - 1:
                continue  # the half stands at another offset
            rest = word[: end + 1 - size] if self.at_end else word[size:]
            for length in (len(word) - 1, len(word), len(word) + 1):
                if (node := by_length.get(length)) is not None:
                    node.near(rest, found)
        if self.at_end:  # the other end's shard answers those
            found = {w: n for w, n in found.items() if not word.startswith(w[: len(w) // 2])}
        return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its halves first: build the shard's automaton, then scan the words that follow."""
    key, halves, shard = None, [], None
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        columns = [batch.column(c).to_pylist() for c in ("end", "outer", "part", "scanned", "word", "n")]
        for *own, scanned, word, n in zip(*columns, strict=True):
            if own != key:
                key, halves, shard = own, [], None
            if not scanned:
                halves.append((word, n))
                continue
            if not halves:
                continue
            if shard is None:
                shard = Shard(bool(own[0]), halves)
            if found := shard.near(word):
                best = min(found, key=lambda w: (-found[w], w))
                out.append((word, len(found), found[best], best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word, n_near, near, near_n`` for each word that has near words: their number and the commonest of them.

    ``words`` has distinct ``word`` and ``n``. Of near words with equal n the first in code-point order counts. Words of
    fewer than ``LEAST_CHARS`` code points take no part.
    """
    known = words.where(F.length("word") >= LEAST_CHARS).select("word", F.col("n").cast("long").alias("n"))
    outer: list[Column] = [F.substring("word", 1, 2), F.substring("word", -2, 2)]
    ends = F.explode(F.array(*[F.struct(F.lit(end).alias("end"), o.alias("outer")) for end, o in enumerate(outer)]))
    halves = known.select("word", "n", ends.alias("e")).select("word", "n", "e.end", "e.outer")
    # One row per end and pair of characters: some 16,000 at most where words are runs of Latin letters.
    parts = halves.groupBy("end", "outer").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    dealt = halves.join(F.broadcast(parts) if parts.count() <= FEW_PAIRS else parts, ["end", "outer"])
    own = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("scanned", F.lit(False))
    scans = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("scanned", F.lit(True))
    key = ["end", "outer", "part"]
    columns = [*key, "scanned", "word", "n"]
    rows = own.select(*columns).unionByName(scans.select(*columns)).repartition(*key).sortWithinPartitions(*key, "scanned")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = rows.mapInArrow(_scan, _SCANNED).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: from each word of ``forms`` (word, form) the last that following forms leads to.

    Pointers are doubled: a round halves all paths, so there are as many rounds as the longest path has binary digits.
    Forms must not run in a circle; here each is at least twice as common as its word.
    """
    spark = forms.sparkSession
    pointers, folder = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pointers.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped, after = written(moved, "roots")
        discard(spark, folder)
        pointers, folder = stepped.select("word", "root"), after
        if stepped.where("moved").isEmpty():
            return pointers


def group(words: DataFrame, least_ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (distinct ``word``, ``n``).

    A word's form is the commonest word one edit away, if at least ``least_ratio`` times as common as the word; its root
    is where following forms ends, the word itself if it has none. Ties go to the first in code-point order. Null words
    go, other columns too; words of fewer than ``LEAST_CHARS`` code points have no near words, words of any length are
    compared whole, and an empty table gives none. A ``least_ratio`` over 1 keeps forms from running in a circle.
    """
    if least_ratio <= 1:
        raise ValueError("least_ratio must be over 1")
    known = materialize(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    common = F.col("near_n") >= F.col("n") * least_ratio
    joined = known.join(near_words(known, shard), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n")
    )
    formed = materialize(joined, "forms")
    ends = roots_of(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
