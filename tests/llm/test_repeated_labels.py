"""A labelled id that repeats over many rows counts once in the fits of the classifiers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.llm import quality, toxicity


@pytest.fixture(scope="module")
def few(documents, spark):
    random.seed(12)
    vocabulary = [f"v{i}" for i in range(60)]
    made = [(i, " ".join(random.choice(vocabulary) for _ in range(80)) + " foul" * (i % 2)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    return made, labels


@pytest.mark.parametrize("module", [toxicity, quality])
def test_repeated_id_is_one_row(documents, few, module):
    made, labels = few
    once, often = (module.fit(documents(made + [made[7]] * n), labels, F.lit(True)) for n in (0, 60))
    if module is toxicity:
        assert (once.index == often.index).all() and (once.weight == often.weight).all() and once.bias == often.bias
    else:
        assert all(np.array_equal(once.p[k], often.p[k]) for k in once.p)


def test_sampled_texts(documents, few, spark):
    made, labels = few
    docs = documents([*made, *[(7, f"another text {i}") for i in range(50)], (8, None)]).repartition(6)
    ids = toxicity.sample_ids(labels, "toxic", F.lit(True), 30)
    found = toxicity.sampled_texts(docs, ids).collect()
    assert len(found) == ids.count() == len({r["id"] for r in found}) == 30
    assert sorted(found) == sorted(toxicity.sampled_texts(docs.repartition(3), ids).collect())
