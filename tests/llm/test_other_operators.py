"""WARC archives, nearest neighbours, URL lists, classifiers, the queries and the pipeline."""

import datetime
import gzip
import hashlib
import io
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import ann, quality, queries, toxicity, url_lists, warc

# --- WARC -------------------------------------------------------------------------------------------------------


def test_archives(spark):
    big = "x" * 150 + "é\r\n\r\nWARC/1.1\r\n"
    made = [(3, "http://a/é b", big), (1, "http://b/", big), (2, None, "small"), (4, "http://c/", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "y" * 200), (1, "again", big)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("kind", F.lit("k"))
    expected = Counter()
    for i, _, html in made:
        data = (html or "").encode()
        again = html == big and i != 1
        expected[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None)] += 1
    found = warc.archive_pages(pages)
    assert Counter(tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_writes_one_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "z" * (i * 997)) for i in range(40)], "page_id long, url string, html string")
    archives = warc.write_monolithic(warc.with_roles(pages).coalesce(1), max_bytes=200_000)
    found = archives.collect()
    assert sum(r["n_records"] for r in found) == 40 and len(found) > 1
    files = warc.write_files(warc.normalize(archives), str(tmp_path / "many")).collect()
    kinds = Counter()
    for r in files:
        data = open(r["path"], "rb").read()
        entries = [json.loads(x) for x in open(r["index_path"])]
        assert len(entries) == r["n_records"] and sum(e["length"] for e in entries) == len(data)
        for e in entries:
            member = gzip.GzipFile(fileobj=io.BytesIO(data[e["offset"] : e["offset"] + e["length"]])).read()
            assert member.startswith(b"WARC/1.1\r\n") and e["record_id"].encode() in member
            if e["kind"] == "response":
                assert b"\r\n\r\nHTTP/1.1 200 OK\r\n" in member
            kinds[e["kind"]] += 1
        assert entries[0]["kind"] == "warcinfo"
    assert kinds["response"] == 40 and kinds["warcinfo"] == len(files) == len(found)
    # Files are read back from storage by Spark, of many members or of one.
    again = warc.normalize(warc.read_files(spark, [r["path"] for r in files]))
    assert sorted(r["page_id"] for r in warc.read_records(again).collect()) == list(range(40))


def test_one_payload_on_most_pages(spark):
    hot = "<p>" + "hot " * 60
    made = [(i, "u", hot) for i in range(3, 200)] + [(None, "u", hot)] * 5 + [(3, "u", "other " * 40), (900, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(6)
    found = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect())
    assert found == Counter({(3, "response", None): 2, (900, "response", None): 1, (None, "revisit", 3): 5} | {(i, "revisit", 3): 1 for i in range(4, 200)})


def test_truncated_archive_is_an_error():
    body = warc.record(1, "u", b"payload", "response", None)
    assert list(warc.records(iter([body[:9], body[9:] + body]))) == [body, body]
    with pytest.raises(ValueError):
        list(warc.records(iter([body[:-3]])))


# --- nearest neighbours -----------------------------------------------------------------------------------------


def exact(vectors, k, step):
    out = set()
    for i, v in vectors:
        if i % step == 0:
            best = sorted((-float(np.dot(w, v)), j) for j, w in vectors if j != i)[:k]
            out |= {(i, rank + 1, j) for rank, (_, j) in enumerate(best)}
    return out


def test_neighbours_of_few_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=8).round(3).tolist()) for i in range(30)] + [(i, [1.0] * 8) for i in range(30, 40)]
    bad = [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [float("inf")] * 8), (180, [None] + [1.0] * 7), (200, [1.0] * 7), (None, [1.0] * 8)]
    table = spark.createDataFrame(good + bad + good[:1], "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("q", F.lit(2))
    found = ann.search(table, F.col("vec_id") % 20 == 0, k=50).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == exact(good, 50, 20)
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    assert all(abs(s - np.dot(good[a][1], good[b][1])) < 1e-12 for (a, b), s in scores.items())
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("clusters", [0, 40, 300])
def test_recall(spark, clusters):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 4000)] * 3 + x * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found, ranks = {}, {}
    for r in ann.search(table, F.col("vec_id") % 50 == 0, k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert all(sorted(ranks[i]) == list(range(1, 21)) for i in range(0, 4000, 50)) and len(ranks) == 80
    x = x.astype(np.float32).astype(float)
    hits = 0
    for i in range(0, 4000, 50):
        s = x @ x[i]
        s[i] = -9
        hits += len(found[i] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 80


def test_every_query_gets_its_neighbours(spark):
    """Small clusters in all directions, repeated ids and hundreds of equal vectors: no list is short."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(300, 16)), 10, axis=0) + rng.normal(size=(3000, 16)) * 0.01
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, (-x[i]).tolist()) for i in range(0, 400, 2)] + [(3000 + i, x[0].tolist()) for i in range(300)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, _ in made if i % 20 == 0}
    for own in found.values():
        ranks, ids, scores = zip(*sorted(own), strict=True)
        assert ranks == tuple(range(1, 21)) and len(set(ids)) == 20 and list(scores) == sorted(scores, reverse=True)


def test_equal_vectors_have_one_score(spark):
    rng = np.random.default_rng(4)
    distinct = rng.normal(size=(25, 24))
    good = [(i, distinct[rng.integers(0, 25)].tolist()) for i in range(601)] + [(i, distinct[3].tolist()) for i in range(601, 900)]
    table = spark.createDataFrame(good, "vec_id long, embedding array<double>").repartition(7)
    found = ann.search(table, F.col("vec_id") % 20 == 0, k=20).collect()

    def order(v, w):
        total = 0.0
        for a, b in zip(v, w, strict=True):
            total += a * b
        return total

    expected = set()
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-order(w, v), j) for j, w in good if j != i)[:20]
            expected |= {(i, rank + 1, j, -score) for rank, (score, j) in enumerate(best)}
    assert {tuple(r) for r in found} == expected


def test_estimates_from_packed_bits():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 70)), rng.normal(size=(9, 70))
    coder = ann.Coder(ann.kmeans(x, 5), np.linalg.qr(rng.normal(size=(70, 70)))[0])
    cell = coder.assign(x)
    bits, length, fit = coder.encode(x, cell)
    estimate, off = coder.bounds(bits, length, fit, cell, q)
    turned = (x - coder.centres[cell]) @ coder.rotation.T
    signs = np.where(turned >= 0, 1, -1) / np.sqrt(70)
    plain = (q @ coder.centres.T)[:, cell] + (q @ coder.rotation.T) @ signs.T * (length / fit)
    assert np.abs(estimate - plain).max() < 0.3 * np.abs(plain).std()
    assert (np.abs(estimate - q @ x.T) <= off).mean() > 0.97


# --- URL lists --------------------------------------------------------------------------------------------------


def test_groups_of_a_domain(spark, monkeypatch):
    """Pairs under one domain meet its changes in several groups, and the joins may be shuffles."""
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    entries = [("com", "add", day(40)), *[("hot.com", action, day(n)) for n in range(0, 60, 4) for action in ["add", "remove"][n // 4 % 2 : n // 4 % 2 + 1]]]
    listed = spark.createDataFrame(entries, "pattern string, action string, effective date")
    captures = spark.createDataFrame([(i, f"http://h{i % 7}.{'hot' if i % 3 else 'cold'}.com/{i}", day(i % 64)) for i in range(500)], "page_id long, url string, fetched date")
    whole = Counter(map(tuple, url_lists.evaluate(captures, listed).collect()))
    assert {k[4] for k in whole} == {None, "com", "hot.com"}
    monkeypatch.setattr(url_lists, "GROUP", 9)
    monkeypatch.setattr(url_lists, "FEW", 0)
    assert Counter(map(tuple, url_lists.evaluate(captures, listed).collect())) == whole


def test_temporal_lists(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    entries = [("bad.example", "add", day(10)), ("bad.example", "remove", day(20)), ("bad.example", "add", day(30)), ("bad.example", "add", day(35)), ("Sub.bad.example", "add", day(15)), ("tie.example", "add", day(5)), ("tie.example", "remove", day(5)), (None, "add", day(1)), ("x", "odd", day(1)), ("y", "add", None), ("4.3", "add", day(1)), ("9.8.7.6", "add", day(1))]
    listed = spark.createDataFrame(entries, "pattern string, action string, effective date")
    asked = [(1, "http://bad.example/a", day(9)), (2, "https://u:p@BAD.example:8080/a?b", day(10)), (3, "http://sub.bad.example", day(16)), (4, "http://bad.example/", day(20)), (5, "http://notbad.example/", day(12)), (6, "http://a.bad.example/", day(400)), (7, "http://tie.example/", day(6)), (8, None, day(12)), (9, "relative/path", day(12)), (10, "http://bad.example/", None), (20, "http://1.2.4.3/", day(12)), (21, "http://9.8.7.6:80/x", day(12)), (None, "http://bad.example/", day(12)), (2, "https://u:p@BAD.example:8080/a?b", day(10))]
    captures = spark.createDataFrame(asked, "page_id long, url string, fetched date").withColumn("pattern", F.lit("z")).withColumn("v", F.lit(1))
    found = Counter((r["page_id"], r["blocked"], r["pattern"], r["listed_since"]) for r in url_lists.evaluate(captures, listed).collect())
    assert found == Counter({(1, False, None, None): 1, (2, True, "bad.example", day(10)): 2, (3, True, "sub.bad.example", day(15)): 1, (4, False, None, None): 1, (5, False, None, None): 1, (6, True, "bad.example", day(30)): 1, (7, False, None, None): 1, (8, False, None, None): 1, (9, False, None, None): 1, (10, False, None, None): 1, (20, False, None, None): 1, (21, True, "9.8.7.6", day(1)): 1, (None, True, "bad.example", day(10)): 1})
    dotted = spark.createDataFrame([(1, "http://bad.example./a", day(12)), (2, "//bad.example/x", day(12)), (3, "//u@Sub.bad.example.:1", day(16)), (4, "/bad.example", day(12)), (5, "http://./", day(12)), (6, "http://com./", day(12))], captures.select("page_id", "url", "fetched").schema)
    again = listed.union(spark.createDataFrame([("Net.example.", "add", day(1)), ("http://com/", "add", day(1))], listed.schema))
    assert {r["page_id"] for r in url_lists.evaluate(dotted, again).where("blocked").collect()} == {1, 2, 3}
    assert url_lists.evaluate(captures.limit(0), listed).count() == 0 and url_lists.evaluate(captures, listed.limit(0)).where("blocked").count() == 0


# --- classifiers ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(documents, spark, odd):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(500)]
    made, labels = [], []
    for i in range(1000, 1600):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic, fine = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["nasty", "vile"])
        if not fine:
            t = [x + "###" for x in t]
        made.append((i, " ".join(t)))
        labels.append((i, int(fine), int(toxic)))
    labels += [(None, 1, 1), (1, None, None), (2, 7, 7), (1000, *labels[0][1:])]
    return documents(made).union(odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.3)])
def test_classifiers(spark, labelled, module, label, cut):
    docs, labels = labelled
    held = toxicity.remainder(3) == 1
    model = module.fit(docs, labels, ~held, label)
    scored = module.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    own = scored.join(labels.where("doc_id > 1000"), "doc_id").where(held).select("score", label).collect()
    right = sum((r["score"] >= cut) == bool(r[label]) for r in own)
    assert len(own) > 100 and right >= 0.95 * len(own)
    again = module.score(docs, module.fit(docs.repartition(5), labels, ~held, label))
    assert sorted(map(str, scored.select("doc_id", "score").collect())) == sorted(map(str, again.select("doc_id", "score").collect()))
    nothing = module.score(docs, module.fit(docs, labels.limit(0), ~held, label))
    assert {r["score"] for r in nothing.select("score").distinct().collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------------------------


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        sizes.append((name, docs.count(), out.count()))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _, _ in sizes] == ["toxicity", "line_dedup", "simhash", "decontaminate", "byte_bpe"]
    assert sizes[1][1] == sizes[1][2] and sizes[4][1] == sizes[4][2] and sizes[2][2] < sizes[2][1] and sizes[3][2] < sizes[3][1]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1][2]
