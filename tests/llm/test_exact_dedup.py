import hashlib
import random
import re

import pytest

from plumbline.llm import exact_dedup as X


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, k))
    out = []
    for k, (d, t) in enumerate(rows):
        best = min(groups[norm(t)])
        out.append((str(d), str(rows[best[3]][0]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    base = ["".join(rng.choice("ab \né🙂") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(30)]
    rows = []
    for k in range(150):
        t = rng.choice(base)
        if rng.random() < 0.4:
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice([" ", "\t\v", "\r\n", " ", "b"]) + t[at:]
        rows.append((k, t))
    return rows + [(None, "ab"), (None, "ab"), (7, "ab"), (7, "ab"), (900, None), (901, ""), (902, " \n"), (903, "ab" * 60_000), (904, "ab" * 59_999 + "a b")]


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_equals_brute_force(spark, size):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, name int").repartition(3)
    got = X.exact_duplicates(docs, size).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_ambiguous_fingerprints_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(X, "_marks", lambda: [F.lit(1).cast("long").alias("f"), (F.length("block") % 2).cast("long").alias("g")])
    rows = corpus()[:60]
    got = X.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)


def test_keep_one_and_empty_table(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({x[3] for x in brute(rows)})
    plain = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in X.keep_one(plain).collect()) == [1, 3]
    assert X.exact_duplicates(plain.limit(0)).count() == 0 == X.keep_one(plain.limit(0)).count()
    assert not re.search("Python|Pandas|Arrow", X.exact_duplicates(plain)._jdf.queryExecution().executedPlan().toString())
