"""The pipeline against a composition of brute-force stages on a small corpus."""

import random

import pytest

import corpus_pipeline
from plumbline.llm import bpe_ids
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_ngram_join import brute as near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(150)] for lang, s in (("en", ("the", "ing", "on")), ("de", ("sch", "ung", "ü")))}
    text = lambda lang, n: [rng.choice(vocabulary[lang]) for _ in range(n)]
    items = [(k, " ".join(text("en", rng.randint(12, 25)))) for k in range(4)]
    docs = []
    for k in range(24):
        lang = ("en", "de")[k % 2]
        base = text(lang, rng.randint(20, 60))
        if k % 6 == 1:
            base[5:5] = rng.choice(items)[1].split()
        docs.append((" ".join(base), lang))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocabulary[lang])
            docs.append((rng.choice([" ", "  ", "\n"]).join(w), lang))
    docs += [("", "en"), ("123 456", "de"), (None, "en"), ("--- !!", None)]
    rng.shuffle(docs)
    rows = [(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), [(r[0], r[1]) for r in rows], items


def test_stages_equal_brute_force(spark, folder):
    sf_dir, rows, items = folder
    left = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    keep = {keep for _, keep, _, _ in copies(left)}
    left = [(d, t) for d, t in left if str(d) in keep]
    keep = {d for d, _, component in near(left) if d == component}
    left = [(d, t) for d, t in left if str(d) in keep]
    gone = {d for d, _ in leaks(items, left)}
    left = [(d, t) for d, t in left if d not in gone]
    assert gone and 10 < len(left) < len(rows) - 10

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
    assert sorted(r.doc_id for r in docs.collect()) == [d for d, _ in left]

    enc = bpe_ids.Encoder(bpe_ids.default_path())
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {d: len(enc.ids(t)) // 4 + 1 for d, t in left}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice(["the", "ing", "on", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    a, b, c, long = text(60), text(50), text(40), text(200_000)
    near = [*a[:30], "another", *a[31:]]
    leak = [*text(20), *(item := text(15)), *text(20)]
    join = " ".join
    rows = [(1, join(a)), (1, join(a)), (1, join(b)), (2, join(near)), (3, join(long)), (4, join(long) + " more"), (None, join(c)), (5, join(leak)), (5, join(c[:20])), (6, None)]
    made = [(d, t, "en", "s", len(t or ""), k, f"m{k}", {"k": k}) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(made, f"{SCHEMA}, _gone int, _mark string, node map<string, int>").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = sorted((str(r.doc_id), len(r.text)) for r in docs.collect())
    assert kept == sorted([("1", len(join(a))), ("1", len(join(b))), ("3", len(join(long))), ("None", len(join(c))), ("5", len(join(c[:20])))])
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 4
