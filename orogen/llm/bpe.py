"""Byte-level BPE over Arrow batches with the tokenizers library, and its inverse.

A ranks file (base64 token, rank) is turned into a byte-level BPE model: every byte has a printable stand-in
character, and every way to split a token into two others is a merge of that token's rank. Texts are cut by the
pattern first and each match is encoded separately, a repeated one once as long as a bounded memory holds (long ones aren't kept). Offsets come from the byte lengths of the tokens and a map from
bytes to characters of the text, so a token may start or end inside a character.

Scale: one map-side pass and no shuffle. The model is built once per Python worker from the vocabulary file, whose
path is a parameter; on a cluster the file is installed beside the tokenizers library on every node.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_or_empty, utf8

_CHUNK_BYTES = 1_000_000
#: Matches that a worker remembers at most (beyond those of one slice of rows), and characters of the longest of them.
_MET = 150_000
_LONG = 48


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


#: Fixed: the pattern whose matches Cutter finds by character classes; any other is run as a regular expression.
CLASS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


class Cutter:
    """Cuts texts into the matches of a pattern: for CLASS_PATTERN from runs of letters, numbers, blanks and others."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.findall = None if pattern == CLASS_PATTERN else regex.compile(pattern).findall
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
        self.kind = np.full(len(every), _OTHER, np.uint8)
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for match in regex.finditer(name, every):
                self.kind[match.start() : match.end()] = kind

    def __call__(self, texts: list[str]) -> list[list[str]]:
        if self.findall:
            return [self.findall(t) for t in texts]
        whole = "".join(texts)
        if not whole:
            return [[] for _ in texts]
        at = np.cumsum([0, *map(len, texts)])
        starts = np.flatnonzero(self._starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), at))
        cuts = np.searchsorted(starts, at).tolist()
        stops = [*starts[1:].tolist(), len(whole)]
        pieces = [whole[a:b] for a, b in zip(starts.tolist(), stops, strict=True)]
        return [pieces[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _starts(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a match starts at each character; ``at`` has the first character of each text, and the end."""
        n = len(code)
        kind = self.kind[code]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first = edge[:n].copy()
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last blank before another character leaves its run: a space goes with what follows, another stands alone.
        blank = kind == _SPACE
        last = np.zeros(n, bool)
        last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
        start |= last
        joined = np.zeros(n, bool)
        joined[1:] = last[:-1] & (code[:-1] == 32)
        start &= ~joined
        # An apostrophe that starts a match takes one or two letters with it, and the letters after those stand apart.
        quote = np.flatnonzero(start & (code == 39))
        room = at[np.searchsorted(at, quote, side="right")] - quote
        one = np.where(room > 1, code[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(room > 2, code[np.minimum(quote + 2, n - 1)], 0)
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        single = np.isin(one, [ord(c) for c in "stmd"])
        length = np.where(single, 2, np.where(pair, 3, 0))
        taken = length > 0
        start[quote[taken] + 1] = False
        after = quote[taken] + length[taken]
        inside = after < at[np.searchsorted(at, quote[taken], side="right")]
        follow = after[inside]
        letters = follow[kind[follow] == _LETTER]
        start[letters] = True
        return start


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        self.vocabulary = sorted(ranks, key=ranks.get)
        table = byte_characters()
        spell = {token: "".join([table[b] for b in token]) for token in ranks}
        merges = [
            (spell[token[:i]], spell[token[i:]])
            for token in self.vocabulary
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = Cutter(pattern)
        self._forget()
        size = 1 + max(ranks.values())
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.table = np.frombuffer(b"".join(self.token), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(self.length)])

    def _forget(self) -> None:
        """Matches met so far, by text, and the ids of all of them in one array."""
        self.known: dict[str, int] = {}
        self.met_start, self.met_length, self.met_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: np.ndarray) -> None:
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > _MET:
            self._forget()
            fresh = list(pieces)
        fresh.sort(key=lambda p: len(p) > _LONG)  # so that the long ones stand last and can be taken off again
        if fresh:
            # A sequence of ready words is one call; word numbers tell which tokens belong to which.
            coded = self.tokenizer.encode_batch([fresh[i : i + 500] for i in range(0, len(fresh), 500)], is_pretokenized=True, add_special_tokens=False)
            words = np.concatenate([np.array(e.word_ids, np.int64) + 500 * i for i, e in enumerate(coded)])
            length = np.bincount(words, minlength=len(fresh))
            self.known |= zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True)
            self.met_start = np.concatenate([self.met_start, len(self.met_ids) + np.cumsum(length) - length])
            self.met_length = np.concatenate([self.met_length, length])
            self.met_ids = np.concatenate([self.met_ids, *[np.array(e.ids, np.uint32) for e in coded]])

    def _forget_long(self, pieces: np.ndarray) -> None:
        long = [p for p in pieces if len(p) > _LONG]
        if long:
            for p in long:
                del self.known[p]
            n = len(self.known)
            self.met_ids = self.met_ids[: self.met_start[n]].copy()
            self.met_start, self.met_length = self.met_start[:n].copy(), self.met_length[:n].copy()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a match that was met before isn't encoded again."""
        found = self.cut(texts)
        codes, pieces = pd.factorize(np.array([p for f in found for p in f], object))
        self._learn(pieces)
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[codes]
        length = self.met_length[index]
        ends = np.cumsum(length)
        ids = self.met_ids[np.repeat(self.met_start[index] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum([len(f) for f in found], dtype=np.int64)]
        self._forget_long(pieces)
        return np.split(ids, stops[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, by the byte table; characters that were split over tokens come together again."""
        ids = ids.astype(np.int64)
        length = self.length[ids]
        total = int(length.sum())
        shift = np.repeat(self.start[ids] - (np.cumsum(length) - length), length)
        return self.table[shift + np.arange(total)].tobytes()

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character of each token; a split character belongs to every token it touches."""
        stop = np.cumsum(self.length[ids.astype(np.int64)])
        start = stop - self.length[ids.astype(np.int64)]
        leads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return leads[start] - 1, leads[stop - 1]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _map(docs: DataFrame, schema: str, build) -> DataFrame:
    """Apply ``build(codec-free batch slice)`` to rows of doc_id and text (null: empty), a bounded slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, _CHUNK_BYTES):
                at = (offsets[lo : hi + 1]).tolist()
                texts = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield build(batch.column("doc_id").slice(lo, hi - lo), texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(lean(run), schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, starts, stops``: token ids with the character range of each token in the text.

    A null or empty text has no tokens. Rows that repeat give repeated results; a null doc_id stays null; other
    columns are ignored, whatever their names. Texts are encoded whole, without special tokens.
    """

    def build(ids, texts):
        own = codec(path, pattern)
        coded = own.encode([t.decode() for t in texts])
        ranges = [own.offsets(t, c) if len(c) else (c, c) for t, c in zip(texts, coded, strict=True)]
        lists = [pa.array(x, pa.list_(pa.int32())) for x in ([c.astype(np.int32) for c in coded], [r[0].astype(np.int32) for r in ranges], [r[1].astype(np.int32) for r in ranges])]
        return pa.RecordBatch.from_arrays([ids, *lists], ["doc_id", "ids", "starts", "stops"])

    return _map(docs, "doc_id long, ids array<int>, starts array<int>, stops array<int>", build)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes``: what the ``ids`` of each row stand for (null: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path, pattern)
            raw = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, on request ``ids`` too: encoded, then decoded from the
    ids alone. Cases as in :func:`encode`."""

    def build(ids, texts):
        own = codec(path, pattern)
        coded = own.encode([t.decode() for t in texts])
        columns = [
            ids,
            pa.array([len(c) for c in coded], pa.int64()),
            pa.array([hashlib.sha256(c.astype("<u4").tobytes()).hexdigest() for c in coded], pa.string()),
            pa.array([hashlib.sha256(own.decode(c)).hexdigest() for c in coded], pa.string()),
        ]
        if with_ids:
            columns.append(pa.array([c.astype(np.int32) for c in coded], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return _map(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, build)
