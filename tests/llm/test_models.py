import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm import language as L
from plumbline.llm import site_quality as Q

DATA = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.train(docs)
    got = L.identify(docs, model).join(docs, "doc_id").withColumn("held", L.held_out(F.col("doc_id")))
    seen = got.where("held").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("rejected").cast("double")).alias("gone")).first()
    assert seen.n > 100 and seen.right >= 0.97 and seen.gone <= 0.01
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.limit(50).collect())


def test_unknown_languages_and_random_letters_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(50)]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."]
    frame = spark.createDataFrame(list(enumerate(noise + foreign)), "doc_id long, text string")
    model = L.train(docs)
    assert sum(r.rejected for r in L.identify(frame, model).collect()) >= 52
    assert L.keep_identified(frame, model).count() <= 1
    held = L.identify(docs.where(L.held_out(F.col("doc_id"))), model)
    assert held.where("rejected").count() <= 0.01 * held.count()
    other = L.train(docs.where("lang <> 'es'"))
    assert L.identify(docs.where("lang = 'es'"), other).agg(F.avg(F.col("rejected").cast("double"))).first()[0] >= 0.9


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = L.train(docs)
    long = docs.where("lang = 'de'").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).first().t
    rows = [(1, None), (2, ""), (3, "12 34 !?\n"), (None, "ñ"), (5, long), (5, long)]
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.identify(frame, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (1, 2, 3):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
        if r.doc_id == 5:
            assert r.lang_pred == "de"
    assert L.keep_identified(frame, model).columns == frame.columns
    none = L.train(frame.where("doc_id = 1"))
    assert {r.lang_pred for r in L.identify(frame, none).collect()} == {"und"}
    assert L.identify(frame.limit(0), model).count() == 0


def test_long_texts_score_as_in_one_piece(spark, monkeypatch):
    import pyarrow as pa

    model = L.train(spark.read.parquet(f"{DATA}/documents.parquet"), 40, 2)
    rng = random.Random(1)
    column = pa.array(["".join(rng.choice("abcé ñß") for _ in range(rng.randint(0, 200))) for _ in range(30)])
    whole = model.logits(column)
    monkeypatch.setattr(L, "_PIECE", 64)
    assert (model.logits(column) == whole).all()


def test_site_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).persist()
    seen = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("kept"))
    kept = {r.quality: r.kept for r in seen.collect()}
    assert kept[1] >= 0.97 and kept[0] <= 0.1 and got.count() == docs.count()


def test_sparse_sites_are_shrunk(spark):
    rng = random.Random(2)
    rows = []
    for host in range(12):
        bad = host % 3 == 0
        for k in range(60):
            word = "ab#$%&*" if bad and k % 10 else "the word"
            rows.append((len(rows), " ".join(word for _ in range(20)), f"h{host}"))
    rows += [(5000, "#$% " * 20, "lonely"), (5001, None, None), (5002, "the word " * 9, None), (None, "the word " * 9, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(d, int("#" not in (t or "#")), 0) for d, t, _ in rows if d is not None and d % 2] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.score(docs, labels, F.col("host"), F.col("host")).collect()}
    assert len(got) == len(rows)
    good, bad = got[60], got[1]
    assert good.p_host > 0.8 > 0.5 > bad.p_host
    # One bad page does not make a site bad: its rate lies nearer to the global one.
    assert got[5000].p_doc < 0.5 and got[5000].p_path > bad.p_path
    none = Q.score(docs, labels.limit(0), F.col("host"), F.col("host")).collect()
    assert {round(r.p_doc, 6) for r in none} == {0.5}
    assert Q.score(docs.limit(0), labels, F.col("host"), F.col("host")).count() == 0


def brute_scores(rows, weight=Q.SITE_WEIGHT):
    """Posteriors and scores from (doc_id, host, path, p), written out with lists."""
    import math

    mean = sum(r[3] for r in rows) / len(rows)

    def grouped(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[3])
        return out

    def strength(groups, center):
        n = sum(map(len, groups.values()))
        within = sum(sum((p - sum(g) / len(g)) ** 2 for p in g) for g in groups.values())
        between = sum(len(g) * (sum(g) / len(g) - center(k)) ** 2 for k, g in groups.items())
        noise = max(1e-6, within / max(1, n - len(groups)))
        spread = (between - (len(groups) - 1) * noise) / max(1.0, n - sum(len(g) ** 2 for g in groups.values()) / n)
        return min(1e6, max(1.0, noise / max(spread, 1e-9)))

    hosts, paths = grouped(lambda r: r[1]), grouped(lambda r: (r[1], r[2]))
    a = strength(hosts, lambda k: mean)
    b = strength(paths, lambda k: (sum(hosts[k[0]]) + a * mean) / (len(hosts[k[0]]) + a))
    odds = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    out = []
    for d, host, path, p in rows:
        g, h = hosts[host], paths[host, path]
        p_host = (sum(g) - p + a * mean) / (len(g) - 1 + a)
        p_path = (sum(h) - p + b * p_host) / (len(h) - 1 + b)
        score = 1 / (1 + math.exp(-(odds(p) + weight * (odds(p_path) - odds(mean)))))
        out.append((d, p_host, p_path, score))
    return out


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(8)
    rate = {}
    rows = []
    for k in range(400):
        host = rng.choice([None, "a", "b", "c", "d", f"lone{k}"])
        path = rng.choice([None, "x", "y"])
        base = rate.setdefault((host, path), rng.random())
        rows.append((k, host, path, min(1.0, max(0.0, rng.gauss(base, 0.2)))))
    rows += [(7, "a", "x", 1.0), (7, "a", "x", 1.0)]
    got = Q.scored(spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double").repartition(3)).collect()
    key = lambda x: (x[0], x[3])
    for mine, want in zip(sorted([(r.doc_id, r.p_host, r.p_path, r.score) for r in got], key=key), sorted(brute_scores(rows), key=key)):
        assert mine[0] == want[0] and all(abs(x - y) < 1e-6 for x, y in zip(mine[1:], want[1:])), (mine, want)


def test_hosts_and_paths_of_pages(spark):
    urls = ["https://blog.x.example/en/78?utm=1", "HTTP://User@WWW.X.example:8080/en", "http://x.example", "https://x.example/?q=/a", "mailto:a@b", None, ""]
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(*Q.site(F.col("url"))).collect()]
    assert [g[0] for g in got] == ["blog.x.example", "x.example", "x.example", "x.example", None, None, None]
    assert [g[1] for g in got[:4]] == ["blog.x.example/en", "x.example/en", "x.example/", "x.example/"]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    model = Q.train(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")))
    rated = Q.scored(Q.evidence(pages, model, *Q.site(F.col("url"))))
    assert rated.count() == pages.count() and rated.where("p_host BETWEEN 0 AND 1 AND score BETWEEN 0 AND 1").count() == pages.count()


def test_language_scores_equal_a_plain_version(spark):
    """Scores, languages and both limits of rejection, n-gram by n-gram, on texts of one piece."""
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = L.train(docs, 60, 3)
    assert 0.05 < model.temperature < 5000 and model.threshold >= 1 / len(model.languages)
    some = [(r.doc_id, r.text) for r in docs.where("length(text) < 3000").limit(40).collect()] + [(9001, "Ab"), (9002, "x1y"), (9003, "..."), (9004, "étude ÉTUDE")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for doc, text in some:
        if not any(c.isalpha() for c in text):
            assert (got[doc].lang_pred, got[doc].score, got[doc].rejected) == ("und", 0.0, True)
            continue
        data = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {text.lower()} ".encode())
        total, often, n = [0] * len(model.languages), [0] * len(model.languages), 0
        for size in L.NGRAMS:
            for at in range(len(data) - size + 1):
                h = size
                for c in data[at : at + size]:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ c
                bucket = ((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - L.BUCKET_BITS)
                n += 1
                for j in range(len(total)):
                    total[j] += int(model.table[bucket, j])
                    often[j] += int(model.usual[bucket, j])
        x = [(t / 65536 / n + b) / model.temperature for t, b in zip(total, model.bias)]
        p = [math.exp(v - max(x)) for v in x]
        p = [v / sum(p) for v in p]
        best = p.index(max(p))
        strange = (often[best] / 65536 / n - model.center[best]) / math.sqrt(model.variance[0] + model.variance[1] / n)
        assert got[doc].lang_pred == model.languages[best] and abs(got[doc].score - p[best]) < 1e-9
        assert got[doc].rejected == (p[best] < model.threshold or strange < model.unusual)


def test_sample_is_the_first_of_a_random_order(spark, monkeypatch):
    rows = [(k, f"text {k}", "a" if k % 50 else "b") for k in range(3000)] + [(5, "text 5", "a"), (6, "other", "a"), (None, "x", "a"), (9999, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    first = {(r.doc_id, r.lang, r.place) for r in L._chosen(docs, 40).collect()}
    assert sorted(p for _, lang, p in first if lang == "a") == list(range(1, 41)) == sorted(p for _, lang, p in first if lang == "b")
    again = {(r.doc_id, r.lang, r.place) for r in L._chosen(docs.repartition(2), 40).collect()}
    everything = {(r.doc_id, r.lang, r.place) for r in L._chosen(docs, 5000).collect()}
    assert again == first <= everything and len(everything) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(3000))
