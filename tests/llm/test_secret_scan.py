import hashlib
import random
import re

import numpy as np

from plumbline.llm import secret_scan as S

A = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [("assign", *m.span()) for m in A.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def texts():
    rng = random.Random(3)
    parts = ["password", "Token", "API_KEY", "apikey", "sécret", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ä", "🙂", "\n", "deadbeef", "zz", "a" * 9, "toKen", "ſecret"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [None, "", "x" * 50_000, "0" * 200_000, "token=" + "a" * 30_000, *made]


def test_base_spans_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "secret: abcdefghijklmn"), (3, "secret: abcdefghijklmn")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = S.digest(S.scan(docs)).collect()
    assert len(got) == len(rows)
    want = {k: brute(t or "") for k, t in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            spans = want[r.doc_id]
            assert r.base_sha256 == hashlib.sha256(S.joined(spans).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
            assert set(S.joined(spans).split(",")) <= set(r.spans.split(",")) | {""}


def test_opaque_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    pool = S.ENCODINGS["base64"][:62]
    word = lambda: "".join(rng.choice(["the", "tion", "er", "ing", "an", "ou"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(300))
    rows = [(k, prose()) for k in range(40)]
    keys = ["".join(rng.choice(pool) for _ in range(32)) for _ in range(10)]
    rows += [(100 + k, f"{prose()} {key} {prose()}") for k, key in enumerate(keys)]
    rows += [(200, "=" * 60), (201, S.ENCODINGS["base64"][:52]), (202, "tionertionertionertionertion" * 2)]
    got = {r.doc_id: r.spans for r in S.digest(S.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = sum("opaque" in got[100 + k] for k in range(10))
    assert found >= 8
    assert not any(got[k] for k in [*range(40), 200, 201, 202])


def test_random_tokens_of_each_alphabet_and_length_look_random():
    rng = random.Random(9)
    for name in ("upper hex", "base32", "lower base32", "base36", "upper base36", "base58", "base62", "base64"):
        for n in (24, 32, 40, 48, 64, 128):
            found = sum(S.looks_random("".join(rng.choice(S.ENCODINGS[name]) for _ in range(n))) for _ in range(200))
            assert found >= 180, (name, n, found)


def test_tokens_of_each_alphabet_are_found_in_text(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["the", "tion", "er", "ing", "an", "ou"]) for _ in range(200))
    names = ["upper hex", "lower base32", "base36", "base58", "base62"]
    rows = [(k, f"{prose()} {''.join(rng.choice(S.ENCODINGS[names[k % 5]]) for _ in range(40))} {prose()}") for k in range(50)]
    got = {r.doc_id: r.spans for r in S.digest(S.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for j, name in enumerate(names):
        assert sum("opaque" in got[k] for k in range(j, 50, 5)) >= 8, name


def test_added_spans_equal_a_brute_force_version(spark):
    """Both Benjamini-Hochberg limits from the sorted p-values of all tokens, instead of histograms."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "tion", "er", "ing", "an", "ou"]) for _ in range(rng.randrange(1, 9)))
    rows = []
    for k in range(150):
        w = [word() for _ in range(60)]
        name = rng.choice(list(S.ENCODINGS)[1:])
        if k % 3 == 0:
            w.insert(rng.randrange(60), "".join(rng.choice(S.ENCODINGS[name]) for _ in range(rng.choice([20, 24, 31, 40, 64, 130]))))
        if k % 5 == 0:
            w.insert(rng.randrange(60), rng.choice(["-=" * 20, S.ENCODINGS["base64"][:52], "ab12" * 9, "=_" * 40, "Q9" * 16]))
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.spans for r in S.digest(S.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    count = np.where(S._IS_TOKEN, 1.0, 0.0)
    for _, t in rows:
        for c in t.encode():
            count[c] += S._IS_TOKEN[c]
    model = np.log(count, where=count > 0, out=np.full(256, -np.inf)) - np.log(count.sum())
    tokens = [(k, m.start(), m.end(), m[0]) for k, t in rows for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t)]

    def rejected(some, p_value):
        """Those that the rule takes at rate 0.01, by length class; p-values are rounded up to quarters of powers of ten."""
        out = set()
        for kind in {S.length_class(len(t[3])) for t in some}:
            mine = [(10.0 ** -(int(-p_value(t[3]) / np.log(10) * 4) / 4), t) for t in some if S.length_class(len(t[3])) == kind]
            fits = [p for p, _ in mine if p * len(mine) / sum(q <= p for q, _ in mine) <= 0.01]
            out |= {t for p, t in mine if fits and p <= max(fits)}
        return out

    found = rejected(tokens, lambda t: S.log_p(t, model))
    added = found - rejected(found, S.battery_log_p)
    want = {}
    for k, a, b, t in added:
        if not any(x < b and a < y for _, x, y in brute(rows[k][1])):
            want.setdefault(k, []).append(("opaque", a, b))
    assert sum(map(len, want.values())) >= 25
    for k, t in rows:
        assert got[k] == S.joined(S.in_order(brute(t) + want.get(k, []))), k


def test_empty_table(spark):
    assert S.digest(S.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
