"""Fill-in-middle against plain string code, odd rows included."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orogen.llm import fill_middle


def expected(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted(h[k] % (len(units) + 1) for k in range(2))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if h[3] % 100 < spm_rate:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(docs, **options):
    made = fill_middle.transform(docs, **options)
    back = made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output",
        F.coalesce("text", F.lit("")).alias("whole"), fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("restored"),
    ).collect()
    assert all(r["whole"] == r["restored"] for r in back)
    found = Counter(tuple(r)[:6] for r in back)
    assert found == Counter(expected(r["doc_id"], r["text"], **options) for r in docs.collect())
    return found


@pytest.mark.parametrize("rate", [50, 100])
def test_odd_rows(odd, rate):
    check(odd, rate=rate)


def test_random_texts(documents):
    random.seed(12)
    parts = [" ", "  ", "\n", "\t", "\x0b", "a", "bc", "é", "\U0001f600", "\xa0", "\x1e", "\x1b", "\x1bc", "\x1be", "<", ">", "P", "S>", "<M", "$1", "\\", "<S"]
    made = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 40)))) for i in range(600)]
    made += [(1000 + i, f"left <{m}> right") for i, m in enumerate("PSMX")] + [(5, None), (None, "no id"), (None, None), (7, "x y"), (7, "x y")]
    forms = Counter(k[2] for k in check(documents(made), rate=90, spm_rate=50))
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 20


def test_columns_and_empty_table(documents):
    docs = documents([(1, "a b c")]).withColumn("n", F.lit(1)).withColumn("form", F.lit("f")).withColumn("a.b", F.lit(2)).withColumn("fim", F.lit(0))
    made = fill_middle.transform(docs)
    assert set(made.columns) == set(docs.columns) and made.select("n", "form", "`a.b`").first() == (1, "f", 2)
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_long_runs(documents):
    text = "".join(random.Random(3).choice("x\U0001f600") for _ in range(300_000))
    check(documents([(i, f"{text} {text[:i]}") for i in range(1, 6)] + [(9, " " * 200_000), (10, "a " * 200_000)]), rate=100)


def test_marks_that_could_arise_between_parts():
    for own in (("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*own)


def test_plan_has_neither_python_nor_exchange(odd):
    plan = fill_middle.transform(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
