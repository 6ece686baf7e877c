"""Byte-level BPE, suffix dedup, decontamination, SimHash and line dedup against brute force, odd rows included."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orogen.llm import bpe, decontaminate, line_dedup, simhash, suffix_dedup
from orogen.llm.queries import tokenizer

BLANK = " \t\n\r\x0b\x0c"


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- byte-level BPE ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_digests(spark, odd, tik):
    path, pattern = tokenizer()
    found = rows(bpe.digests(odd, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = Counter()
    for i, t in texts(odd):
        ids = tik.encode_ordinary(t)
        expected[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))] += 1
    assert found == expected
    assert bpe.digests(odd.limit(0), path, pattern).count() == 0


def test_bpe_offsets_and_decoding(spark, odd):
    path, pattern = tokenizer()
    coded = bpe.encode(odd, path, pattern)
    whole = dict(texts(odd.where("doc_id in (6, 10)")))
    own = bpe.codec(path, pattern)
    for r in coded.where("doc_id in (6, 10)").collect():
        text = whole[r["doc_id"]]
        for token, a, b in zip(r["ids"], r["starts"], r["stops"], strict=True):
            assert own.token[token] in text[a:b].encode()
    back = bpe.decode(coded, path, pattern).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == Counter(texts(odd))


def test_bpe_random_strings(tik):
    random.seed(4)
    parts = ["'", "'s", "'re", "'l", " ", "  ", "\n", "\t", "a", "re", "Sure", "12", "é", "!", "'ll", "d", " 'm", " ", "日", "́", " ", "½"]
    own = bpe.codec(*tokenizer())
    made = ["".join(random.choice(parts) for _ in range(random.randint(0, 15))) for _ in range(4000)]
    assert [c.tolist() for c in own.encode(made)] == [tik.encode_ordinary(t) for t in made]


def test_bpe_keeps_no_long_matches(tik):
    own = bpe.codec(*tokenizer())
    random.seed(14)
    blobs = ["".join(random.choice("abcdefghij") for _ in range(random.choice([20, 60, 5_000]))) for _ in range(60)]
    for lo in range(0, 60, 10):
        made = [" ".join(random.sample(blobs[: lo + 10], 8)) for _ in range(5)]
        assert [c.tolist() for c in own.encode(made)] == [tik.encode_ordinary(t) for t in made]
        assert max(map(len, own.known)) <= bpe._LONG and len(own.met_ids) == own.met_length.sum()


# --- suffix-array dedup -----------------------------------------------------------------------------------------


def removed(docs, window):
    """Brute force: every window of every row, counted."""
    data = [(i, t.encode()) for i, t in docs]
    count = Counter(t[k : k + window] for _, t in data for k in range(len(t) - window + 1))
    out = Counter()
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(t), int(gone.sum()), runs, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))] += 1
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup(spark, documents, group):
    random.seed(5)
    words = [f"{random.choice('abcdeé')}{random.randint(0, 999)}" for _ in range(400)]
    base = [" ".join(random.choice(words) for _ in range(120)) for _ in range(6)]
    made = []
    for i in range(60):
        t = random.choice(base).split(" ")
        for _ in range(random.randint(0, 3)):
            t[random.randrange(len(t))] = f"edit{random.randint(0, 9)}"
        cut = random.randint(0, 80)
        made.append((i, " ".join(t[cut:] + random.choice(base).split(" ")[: random.randint(0, 60)])))
    made += [(1, None), (100, ""), (101, "ab" * 300), (102, "z" * 199), (None, base[0]), (103, base[1]), (103, base[1])]
    docs = documents(made)
    found = rows(suffix_dedup.deduplicate(docs, 200, group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == removed([(i, t or "") for i, t in made], 200)


def test_suffix_dedup_odd(spark, odd):
    found = rows(suffix_dedup.deduplicate(odd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    small = [(i, t) for i, t in texts(odd) if len(t) < 10_000]
    assert {k: v for k, v in found.items() if k[0] not in (4, 5)} == dict(removed(small, 200))
    assert all(k[1] == k[2] and k[3] == 1 for k in found if k[0] in (4, 5))
    assert suffix_dedup.deduplicate(odd.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [2, 3, 40])
@pytest.mark.parametrize("doc_id", [1, None])
def test_suffix_dedup_of_repeated_rows(spark, documents, copies, doc_id):
    """Rows of one doc_id and text, none of which stands elsewhere, and another text that shares a part of theirs."""
    random.seed(copies)
    text = "".join(random.choice("abcdefgh") for _ in range(700))
    made = [(doc_id, text)] * copies + [(2, text[300:][::-1]), (3, "x" * 199), (3, "x" * 199), (4, text[100:350] + "end"), (5, None), (5, None)]
    found = rows(suffix_dedup.deduplicate(documents(made), 200), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == removed([(i, t or "") for i, t in made], 200)
    assert found[(doc_id, 700, 700, 1, sha(""))] == copies


def test_suffix_array_by_grouping():
    random.seed(6)
    for _ in range(400):
        t = [random.randint(1, random.choice([1, 2, 4])) for _ in range(random.randint(0, 30))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i, t=t: t[i:])


@pytest.mark.parametrize("chunk", [300, 1_000_000])
def test_pieces_of_a_long_row_hold_every_window(chunk):
    from orogen.llm.common import SpanHasher

    data = np.frombuffer((b"0123456789abcdef" * 3 + b"some filler " * 40) * 4, np.uint8)
    offsets = np.array([0, 250, 250, 251, len(data)])
    seen = set()
    for found in suffix_dedup.occurrences(data, offsets, 200, SpanHasher(), chunk):
        for row, lo, windows, more in zip(*(found[c].tolist() for c in ("row", "lo", "windows", "more")), strict=True):
            own = {(row, k) for k in range(lo, lo + windows)}
            assert not own & seen
            seen |= own
    assert seen == {(r, k) for r in range(4) for k in range(max(0, offsets[r + 1] - offsets[r] - 199))}


def test_runs_are_a_few_rows(spark, documents):
    from orogen.llm.common import SpanHasher

    made = [(1, "a" * 10_000), (2, "ab" * 5_000), (3, "x" * 40 + "a" * 230), (4, "ba" * 100 + "!"), (5, "a" * 199 + "b")]
    for _, t in made[:2]:
        found = list(suffix_dedup.occurrences(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 200, SpanHasher()))
        assert sum(len(f["row"]) for f in found) < 20
    got = rows(suffix_dedup.deduplicate(documents(made)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(made, 200)


def test_rows_are_told_apart_when_hashes_meet(spark, documents):
    """Texts whose 32-bit hashes are equal, under null and repeated ids, of equal and of different lengths."""
    made = spark.range(400_000).select(F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(4)]).alias("t"))
    made = made.withColumn("t", F.when(F.crc32(F.col("t").cast("binary")) % 2 == 0, F.repeat("t", 1)).otherwise(F.concat("t", F.lit(" tail" * 20))))
    meet = made.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1).limit(8).collect()
    assert len(meet) >= 4
    docs = []
    for i, r in enumerate(meet):
        a, b = r["ts"][:2]
        docs += [(None, a), (None, b), (i % 2, a), (i % 2, b), (100 + i, a[:250])]
    lone = [(None, r["ts"][0]) for r in meet[:2]] + [(None, r["ts"][1]) for r in meet[:2]]
    for own in (docs, lone):
        got = rows(suffix_dedup.deduplicate(documents(own)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == removed(own, 200)


def test_many_contexts_of_one_anchor(spark, documents):
    """A passage in many documents: shorter than a window, or longer with other text on both sides, and far beyond a group."""
    random.seed(15)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(6))
    short, long = (" ".join(word() for _ in range(n)) for n in (24, 40))
    made = [(i, " ".join([word() for _ in range(30)] + [short if i % 2 else long] + [word() for _ in range(30)])) for i in range(160)]
    made += [(i, made[i - 200][1]) for i in range(200, 230)]
    got = rows(suffix_dedup.deduplicate(documents(made), 200, 20), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == removed(made, 200)


def test_a_row_of_nine_megabytes(spark, documents):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 9_000_000, dtype=np.uint8)).decode()
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicate(documents([(1, text), (2, text[4_000_100:4_000_400] + "!" * 150), (3, "q" * 300)])).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"], got[3]["n_removed"]) == (300, 1, 300, 300)
    assert got[1]["kept_sha256"] == sha(text[:4_000_100] + text[4_000_400:])


# --- decontamination --------------------------------------------------------------------------------------------


def words(text):
    out, run = [], ""
    for c in lower(text):
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 128:
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def hits(docs, items, window=13):
    pattern = defaultdict(set)
    for item, text in items:
        w = words(text or "")
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pattern[tuple(w[k : k + m])].add(str(item))
    sizes = {len(p) for p in pattern}
    out = Counter()
    for i, text in docs:
        w = words(text)
        hit, held = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in pattern:
                    hit.update(range(k, k + m))
                    held |= pattern[tuple(w[k : k + m])]
        out[(i, len(w), len(hit), ",".join(sorted(held)))] += 1
    return out


@pytest.mark.parametrize("slice_chars", [8_000_000, 200])
def test_decontamination(spark, documents, odd, slice_chars):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ab"]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice([2, 5, 13, 14, 30])))) for i in range(20)] + [(3, "w1 w2"), (50, None), (51, "!!"), (None, "w1 w1")]
    made = []
    for i in range(60):
        t = [random.choice(vocabulary) for _ in range(random.randint(0, 300))]
        if i % 2:
            passage = random.choice(items)[1] or ""
            t[len(t) // 2 : len(t) // 2] = passage.upper().split(" ")
        made.append((i, random.choice([" ", ", ", "\n"]).join(t)))
    docs = documents(made).union(odd)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark, slice_chars=slice_chars)
    assert found.columns == [*docs.columns, "contamination"] and {r[0] for r in found.select("n_words").distinct().collect()} == {"x"}
    got = rows(found.select("doc_id", "contamination.n_words", decontaminate.n_hit().alias("n"), F.array_join("contamination.items", ",")), "*")
    assert got == hits(texts(docs), [x for x in items if x[0] is not None])
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where(F.size("contamination.items") > 0).count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, documents, odd):
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(300)]
    made = []
    for i in range(100, 160):
        t = [random.choice(vocabulary) for _ in range(150)]
        made.append((i, " ".join(t)))
        for j in range(random.randint(0, 3)):
            u = t[:]
            u[random.randrange(len(u))] = "edited"
            made.append((1000 - i * 4 - j, " ".join(u).upper()))
    docs = documents(made).union(odd)
    every = texts(docs)
    prints = {(i, t): fingerprint(t) for i, t in every}
    nodes = defaultdict(list)
    for (i, _), f in prints.items():
        if i is not None:
            nodes[f].append(i)
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for f, ids in nodes.items():
        least[root(f)] = min(least[root(f)], *ids)
    expected = Counter((i, f"{prints[(i, t)]:016x}", None if i is None else least[root(prints[(i, t)])]) for i, t in every)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, _, c in expected if c is not None}) and kept.count(None) == 1


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(9)
    codes = np.unique(np.concatenate([rng.integers(0, 2**32, 60), 5 ^ (1 << rng.integers(0, 32, 40)) ^ (1 << rng.integers(0, 32, 40))]).astype(np.uint64))
    a, b = simhash.trie_self_join(codes, np.zeros(len(codes), np.int64), 32, 2)
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == {(i, j) for i, j in itertools.combinations(range(len(codes)), 2) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 2}
    assert len(a) == len(found)


@pytest.mark.parametrize("few", [0, 1_000])
def test_components_of_a_path(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "u long, v long")
    found = {r["node"]: r["component"] for r in simhash.components(edges, few).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 100: 90}


@pytest.mark.parametrize("leaf", [16, 300, None])
def test_links_under_one_very_full_prefix(spark, leaf):
    """Most codes share their 50 highest bits; the others are all over, and some are near the full prefix."""
    rng = np.random.default_rng(12)
    full = (0x9ABCDEF012345 << 14) & (2**64 - 1)
    codes = {full | int(x) for x in rng.integers(0, 1 << 14, 600)} | {int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)}
    codes |= {c ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for c in list(codes)[:200]}
    codes = sorted(codes)
    table = spark.createDataFrame([(int(np.uint64(c).view(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long").repartition(5)
    for budget in (1, 2, 3):
        found = simhash.links(table, budget, leaf).collect()
        assert all((codes[r["u"]] ^ codes[r["v"]]).bit_count() <= budget for r in found)
        parent = list(range(len(codes)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(range(len(codes)), 2):
            if (codes[i] ^ codes[j]).bit_count() <= budget:
                parent[max(root(i), root(j))] = min(root(i), root(j))
        own = list(range(len(codes)))
        for r in found:
            a, b = own[r["u"]], own[r["v"]]
            own = [min(a, b) if x in (a, b) else x for x in own]
        assert own == [root(i) for i in range(len(codes))]


def test_cut_of_a_trie_bounds_its_leaves(spark):
    rng = np.random.default_rng(13)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 500, dtype=np.uint64), np.uint64(7 << 60) + rng.integers(0, 1 << 12, 900, dtype=np.uint64)]))
    cut = simhash.Cut.of(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long"), 40)
    row, leaf, off = cut.visits(codes, 0)
    assert np.bincount(leaf).max() <= 40 and (off == 0).all() and sorted(row) == list(range(len(codes)))


# --- line dedup -------------------------------------------------------------------------------------------------


def kept_lines(docs):
    lines = [(i, t.split("\n")) for i, t in docs]
    key = lambda line: lower(line.strip(BLANK))
    holders = defaultdict(set)
    for i, ls in lines:
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, ls in lines:
        drop = [len(holders[key(x)]) >= 3 and max(holders[key(x)]) != (-1 if i is None else i) if len(key(x)) >= 20 else False for x in ls]
        out.append((i, len(ls), sum(drop), "\n".join(x for x, d in zip(ls, drop, strict=True) if not d)))
    return out


@pytest.fixture(scope="module")
def lined(documents, odd):
    random.seed(10)
    pool = [f"a line that is shared, number {i} é" for i in range(30)] + ["short", "", "  exactly twenty chars ", "NINETEEN CHARACTERS"]
    made = [(i, "\n".join(random.choice(["", " ", "\t"]) + random.choice(pool).swapcase() if random.random() < 0.3 else random.choice(pool) for _ in range(random.randint(0, 12)))) for i in range(200, 320)]
    return documents([*made, (5000, "hot line, the same in all of these documents"), *[(i, "hot line, the same in all of these documents") for i in range(400, 900)]]).union(odd)


def test_line_dedup(spark, lined):
    expected = kept_lines(texts(lined))
    assert sum(n for _, _, n, _ in expected) > 500
    assert rows(line_dedup.digests(lined), "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter((i, n, d, sha(k)) for i, n, d, k in expected)
    cleaned = line_dedup.without_repeated_lines(lined.repartition(7))
    assert cleaned.columns == lined.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in cleaned.collect()) == Counter((i, k) for i, _, _, k in expected)
    assert line_dedup.digests(lined.limit(0)).count() == 0
