import hashlib
import random
import re

import pytest

from plumbline.llm import personal_data as P


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 % 10 + int(c) * 2 // 10 for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            spans.append((2, *m.span()))
    spans += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["a.b", "@", "x-y", ".com", "c@d.e", " ", "+1", "+", "(578)", " 555", "-6437", "4918187128635271", "4111 1111 1111 1111", "10.0.0.1", "300.1.1.1", ".", "7", "é", "🙂", "\n", "1.2.3.4.5.6.7.8", "0255.1.1.1", "_", "%", "-", "12", "00000000000000000", "９"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)]
    long = ["a" * 100_000, "1 " * 40_000, "9" * 100_000, "a.b@" * 20_000, "+1" + " " * 50_000 + "2", "1." * 30_000, "+1 2345678 " * 3_000]
    return [(k, t) for k, t in enumerate([None, "", *long, *made])] + [(None, "x@y.zz"), (9, "x@y.zz"), (9, "x@y.zz")]


def test_base_spans_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kind int, start int")
    got = P.digest(P.find(docs)).collect()
    assert len(got) == len(rows)
    want = {k: brute(t or "") for k, t in rows}
    for r in got:
        if r.doc_id is None or r.doc_id == 9:
            continue
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in range(4))
        assert not spans or set(joined(spans).split(",")) <= set(r.spans.split(","))


def test_cards_in_any_grouping_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["paid 411 111 111 111 111 1 now", "41 11 11 11 11 11 11 11"]
    for _ in range(60):
        digits, at, groups = rng.choice(["4111111111111111", "4918187128635271", "6011000990139424"]), 0, []
        sizes = rng.choice([(1,), (2,), (3,), (2, 3), (1, 2, 3), (1, 2, 3, 4, 5)])
        while at < len(digits):
            groups.append(digits[at : at + rng.choice(sizes)])
            at += len(groups[-1])
        texts.append(f"paid {rng.choice([' ', '-']).join(groups)} now")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.digest(P.find(docs)).collect()}
    for k, text in enumerate(texts):
        spans = brute(text)
        assert sum(s[0] == 2 for s in spans) == got[k].n_card, text
        assert got[k].base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), text


def test_the_method_adds_what_the_formats_miss(spark):
    texts = ["tion er an +1 (578) 555-6437 4918187128635271 the on", "write to jo.li [at] mail [dot] com please", "order 123 456 7890-12 was 17", "ISBN 9783161484100 and 20240101120000", "only words here"]
    got = {r.doc_id: r.spans for r in P.digest(P.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got[0] == "card:29:45,phone:11:28"
    assert got[3] == got[4] == ""


def test_a_masked_address_is_added(spark):
    docs = spark.createDataFrame([(1, "write to jo.li [at] mail [dot] com please")], "doc_id long, text string")
    assert P.digest(P.find(docs)).first().spans == "email:9:34"


def test_masked_addresses_of_unseen_sentences(spark):
    made = [m for m in P._examples(600, seed=77) if m[3] == "email"]
    texts = [m[0] for m in made] + ["reach jo [at] mail.com. Then go", "sold 12 (at) 3.50 order x", "reach jo [at] mail . com today"]
    got = [r.spans for r in sorted(P.digest(P.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect(), key=lambda r: r.doc_id)]
    assert len(made) > 80 and sum(f"email:{a}:{b}" in s for (_, a, b, _), s in zip(made, got)) >= 0.95 * len(made)
    assert got[-3:] == ["email:6:22", "", "email:6:24"]


def test_added_spans_are_chosen_as_in_a_plain_version(spark, rows):
    """With a model that takes every proposal: those free of base spans, by start and the longer first."""
    every = P.Model(9.0, (), 1.0, 0.0, (0.5,) * len(P.KINDS))
    some = [(k, t) for k, t in rows if k and k > 8 and k != 9] + [(5001, "411111111111111 (578) 555-6437 123 456 7890 4111111111111111 2 123-456-7890-4444"), (5002, "12 (578) 555-6437 1234567890123 1 415 555 2671 jo (at) 415 555 2671.com")]
    got = {r.doc_id: r.spans for r in P.digest(P.find(spark.createDataFrame(some, "doc_id long, text string"), every)).collect()}
    n = 0
    for k, text in some:
        spans = brute(text)
        more = [(m.start(), -m.end(), j, P.KINDS.index(g.kind)) for j, g in enumerate(P.GENERATORS) if not g.base for m in re.finditer(g.pattern, text)]
        last = -1
        for a, b, _, kind in sorted(more):
            if a >= last and not any(x < -b and a < y for _, x, y in brute(text)):
                spans.append((kind, a, -b))
                last, n = -b, n + 1
        assert got[k] == joined(sorted(spans)), text
    assert n > 100


def test_no_python_runs_on_executors(spark):
    docs = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = P.digest(P.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert P.digest(P.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
