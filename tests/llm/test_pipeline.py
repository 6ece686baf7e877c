"""Each stage of the pipeline against brute force, on odd rows with columns of clashing names."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import bpe, toxicity
from orogen.llm.common import quoted
from orogen.llm.queries import tokenizer

from test_classifiers import shingle_features
from test_near_copies import survivors
from test_text_operators import hits, kept_lines, sha

CLASHING = ["items", "n_words", "hit_spans", "contamination", "__contamination", "toxicity", "__toxicity", "__nth", "ids", "n_tokens", "__gone", "token", "parity", "a.b", "a", "c`d"]


@pytest.fixture(scope="module")
def corpus(spark, documents, odd, tmp_path_factory):
    random.seed(21)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(20))) for i in range(8)] + [(None, "w1 w2"), (9, None)]
    made, labels = [], []
    for i in range(200, 420):
        t = [random.choice(vocabulary) for _ in range(random.randint(1, 60))]
        toxic = i % 3 == 0
        if toxic:
            t += ["foul", "vile"]
        if i % 7 == 0:
            t += items[i % 8][1].upper().split()
        made.append((i, " ".join(t) + "\na line that very many of these documents hold" * (i % 2)))
        labels.append((i, i % 2, int(toxic)))
    made += [(5_000, made[3][1]), (5_001, made[3][1] + " tail"), (made[9][0], "another text of the same id"), made[11], (None, made[3][1])]
    docs = documents(made).union(odd).withColumn("n_chars", F.length("text").cast("int"))
    docs = docs.withColumns({c: F.lit("kept") for c in CLASHING}).repartition(5)
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_toxicity(spark, corpus):
    docs, folder = corpus
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.remainder(3) != 1)
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    expected = Counter()
    for (i, text), n in pairs(docs).items():
        total = model.bias + sum(weights.get(f, 0.0) for f in shingle_features(text or ""))
        if 1 / (1 + np.exp(-total)) < corpus_pipeline.REJECT:
            expected[(i, text)] += n
    found = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert pairs(found) == expected and 0 < expected.total() < docs.count() and weights
    unchanged(docs, found)


def unchanged(docs, found):
    assert found.columns == docs.columns
    assert not found.count() or [tuple(r) for r in found.select(*quoted(*CLASHING)).distinct().collect()] == [("kept",) * len(CLASHING)]


def test_line_dedup(spark, corpus):
    docs, folder = corpus
    found = corpus_pipeline.drop_repeated_lines(spark, docs, folder)
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = Counter((i, None if t is None else k) for (i, t), (_, _, _, k) in zip(every, kept_lines([(i, t or "") for i, t in every]), strict=True))
    assert pairs(found) == kept and pairs(found) != pairs(docs)
    assert found.where(~F.col("n_chars").eqNullSafe(F.length("text"))).count() == 0
    unchanged(docs, found)


def test_near_duplicates(spark, corpus):
    docs, folder = corpus
    found = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = Counter(r["doc_id"] for r in found.collect())
    assert ids.pop(None) == sum(i is None for i, _ in every)
    assert sorted(ids.elements()) == survivors(every)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), folder)
    assert pairs(again) == pairs(found)  # of the rows of an id always the same one
    unchanged(docs, found)


def test_decontamination(spark, corpus):
    docs, folder = corpus
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] is not None]
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = Counter()
    for i, text in every:
        ((_, words, hit, _),) = hits([(i, text or "")], items)
        if not (hit > 0 and 20 * hit >= words):
            expected[(i, text)] += 1
    found = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert pairs(found) == expected and expected.total() < len(every)
    unchanged(docs, found)


def test_tokenize(spark, corpus):
    import tiktoken

    docs, folder = corpus
    path, pattern = tokenizer()
    tik = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = Counter()
    for (i, text), n in pairs(docs).items():
        expected[(i, tuple(tik.encode_ordinary(text or "")), sha(text or ""))] += n
    found = corpus_pipeline.tokenize(spark, docs, folder)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in found.collect()) == expected


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, corpus, stage):
    docs, folder = corpus
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_ids_of_many_texts_count_all_of_them():
    assert survivors([(1, "a"), (2, "b"), (3, "a")]) == [1, 2] and defaultdict(int)[0] == 0
