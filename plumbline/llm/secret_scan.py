"""Secrets: fixed formats, and opaque tokens found by a battery of randomness tests under false-discovery control.

One pass over the texts lists, per document, the spans of the fixed formats and the candidates: runs of 20 or more
characters that an encoding of random bytes would use. It also counts the characters of the corpus. Then

* discovery: under the null hypothesis a candidate is ordinary text, with the corpus's own character frequencies. The
  mean likelihood ratio of uniform draws from the encodings' alphabets has expectation one under it, so its inverse is a
  valid p-value, and long tokens can reach lower ones. Within length classes the Benjamini-Hochberg rule, over a
  histogram of all candidates of the corpus, sets the limit for a false-discovery rate.
* battery: a discovered token must also look random in the encoding inferred for it: chi-squared uniformity of its
  alphabet, a runs test about the median and lag-one serial correlation, each two-sided. Their least p-value, times
  three, is the token's p-value under true randomness. Here too the Benjamini-Hochberg rule sets the limit by length
  class, over all discovered tokens of the corpus: of those taken for structured, a share of BATTERY_RATE at most is
  random. Rulers, alphabets and repeated blocks, which are unlike text but not random, fail here.

Spans of fixed formats stay whatever the tests say; a token that overlaps one is not listed again. Offsets are code
points, end exclusive; the span of an assignment is its whole match.

Defined results: null text is empty; rows without a span have counts of 0, the digest of the empty string and empty
spans; repeated rows and null doc_ids are scanned like any other; an empty table gives no rows. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, written
from .flat import flat_bytes, points, runs

#: Kinds in the order of ties.
ASSIGN, ACCESS, HEX, OPAQUE = KINDS = ("assign", "access", "hex", "opaque")
LEAST = {ASSIGN: 12, ACCESS: 18, HEX: 16, OPAQUE: 20}
DISCOVERY_RATE, BATTERY_RATE = 0.01, 0.01

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")

#: Alphabets of the encodings, in the order of their symbols' values; smaller ones first.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "upper hex": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "lower base32": _UPPER.lower() + "234567",
    "base36": _DIGITS + _UPPER.lower(), "upper base36": _DIGITS + _UPPER, "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": _DIGITS + _UPPER + _UPPER.lower(), "base64": _UPPER + _UPPER.lower() + _DIGITS + "+/",
}
_TOKEN = _UPPER + _UPPER.lower() + _DIGITS + "+/_=-"
#: Upper ends of the length classes.
CLASSES = (24, 32, 48, 64, 128)
#: p-values are counted in bins of a quarter of a power of ten.
_BINS, _MOST_BIN = 4, 1200


def _mask(characters: str) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(characters.encode())] = True
    return mask


_IS_HEX, _IS_TOKEN = _mask(ENCODINGS["hex"]), _mask(_TOKEN)


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats of a text, whose runs of hexadecimal digits are given."""
    spans = [(HEX, a, b) for a, b in hexes]
    low = text.lower()
    if any(k in low for k in _KEYS):
        spans += [(ASSIGN, *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST[ASSIGN]]
    if "AKIA" in text:
        spans += [(ACCESS, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST[ACCESS]]
    return in_order(spans)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_LISTED = "doc_id long, base array<struct<kind:string,start:int,stop:int>>, tokens array<struct<start:int,token:string>>, counts array<long>"


def listed(docs: DataFrame) -> DataFrame:
    """A written table: a row per document with its base spans and candidate tokens, and a row per task, with doc_id and
    base null, that counts the bytes of the task's texts."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string())]))
    names = ["doc_id", "base", "tokens", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(256, dtype=np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                data, starts = flat_bytes(batch.column(1))
                count += np.bincount(data, minlength=256)
                hexes, tokens = {}, {}
                for row, a, b in zip(*(x.tolist() for x in runs(_IS_HEX[data], starts, LEAST[HEX]))):
                    at = points(data, starts[row], a)
                    hexes.setdefault(row, []).append((at, at + b - a))
                for row, a, b in zip(*(x.tolist() for x in runs(_IS_TOKEN[data], starts, LEAST[OPAQUE]))):
                    tokens.setdefault(row, []).append({"start": points(data, starts[row], a), "token": data[a:b].tobytes().decode()})
                base = [
                    [{"kind": s[0], "start": s[1], "stop": s[2]} for s in base_spans(text.as_py() or "", hexes.get(row, []))]
                    for row, text in enumerate(batch.column(1))
                ]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(base, span), pa.array([tokens.get(r, []) for r in range(n)], token), pa.nulls(n, pa.list_(pa.int64()))], names
                )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, span), pa.nulls(1, token), pa.array([count.tolist()], pa.list_(pa.int64()))], names)

    return written(columns(docs, "doc_id", "text").mapInArrow(run, _LISTED), "secrets")


def text_model(table: DataFrame) -> np.ndarray:
    """Log-probability of each byte in tokens of ordinary text: 256 sums over the whole corpus, add-one smoothed."""
    rows = table.where("base IS NULL").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    count = np.where(_IS_TOKEN, 1.0, 0.0)
    for r in rows:
        count[r.pos] += r.n if _IS_TOKEN[r.pos] else 0
    with np.errstate(divide="ignore"):
        return np.log(count / count.sum())


def log_p(token: str, model: np.ndarray) -> float:
    """Natural logarithm of the p-value of a token under ordinary text; 0 at most."""
    codes = np.frombuffer(token.rstrip("=").encode(), dtype=np.uint8)
    ordinary, ratios = model[codes].sum(), []
    for alphabet in ENCODINGS.values():
        if set(token.rstrip("=")) <= set(alphabet) | ({"_", "-"} if len(alphabet) == 64 else set()):
            ratios.append(-len(codes) * math.log(len(alphabet)) - ordinary)
    if not ratios:
        return 0.0
    return min(0.0, math.log(len(ENCODINGS)) - float(np.logaddexp.reduce(ratios)))


def _normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> dict[str, float]:
    """p-values of the tests for the smallest encoding that has all of a token's characters, under true randomness."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    alphabet = next((a for a in ENCODINGS.values() if set(body) <= set(a)), None)
    if alphabet is None or len(body) < 8:
        return {"uniform": 0.0, "runs": 0.0, "serial": 0.0}
    values = np.asarray([alphabet.index(c) for c in body], dtype=float)
    n, kinds = len(values), len(alphabet)
    seen = np.bincount(values.astype(int), minlength=kinds)
    # Cells are few against symbols: the exact mean and variance of the statistic, and a two-sided normal limit.
    chi = float(((seen - n / kinds) ** 2).sum() * kinds / n)
    free = kinds - 1
    uniform = _normal((chi - free) / math.sqrt(2 * free * (n - 1) / n))
    high = values >= kinds / 2
    ups, downs = int(high.sum()), int(n - high.sum())
    if ups and downs:
        mean = 1 + 2 * ups * downs / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        run_p = _normal(((1 + int((high[1:] != high[:-1]).sum())) - mean) / spread)
    else:
        run_p = 2.0 ** (1 - n)
    gap = values - values.mean()
    r = float((gap[1:] * gap[:-1]).sum() / max(1e-9, (gap * gap).sum()))
    return {"uniform": uniform, "runs": run_p, "serial": _normal((r + 1 / n) * math.sqrt(n))}


def battery_log_p(token: str) -> float:
    """Natural logarithm of the battery's p-value; 0 at most."""
    return math.log(max(1e-300, min(1.0, 3 * min(battery(token).values()))))


def looks_random(token: str) -> bool:
    """Whether a token passes the battery by itself; scan() compares it with the others of its length class."""
    return battery_log_p(token) >= math.log(BATTERY_RATE)


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES)


def _bin(logp: float) -> int:
    return min(_MOST_BIN, int(-logp / math.log(10) * _BINS))


def limits(counts: dict[tuple[int, int], int], rate: float = DISCOVERY_RATE) -> dict[int, int]:
    """By length class, the lowest bin that is discovered: Benjamini-Hochberg with each bin's highest p-value."""
    out = {}
    for kind in {k for k, _ in counts}:
        bins = sorted((b for k, b in counts if k == kind), reverse=True)
        total, so_far, least = sum(counts[kind, b] for b in bins), 0, _MOST_BIN + 1
        for b in bins:
            so_far += counts[kind, b]
            if 10.0 ** (-b / _BINS) * total / so_far <= rate:
                least = b
        out[kind] = least
    return out


def scan(docs: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, stop) of every row; spans has the base ones and the opaque tokens."""
    table = listed(docs)
    model = text_model(table)

    def histogram(batches: Iterator[pa.RecordBatch], p_value, keep) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                for t in (x["token"] for x in tokens):
                    if keep(t):
                        key = (length_class(len(t)), _bin(p_value(t)))
                        count[key] = count.get(key, 0) + 1
        rows = [(*k, n) for k, n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.int64()))], ["kind", "bin", "n"])

    def counted(p_value, keep) -> dict[tuple[int, int], int]:
        """Tokens by length class and bin of their p-value: at most classes x bins rows reach the driver."""
        found = table.where("size(tokens) > 0").select("tokens").mapInArrow(lambda b: histogram(b, p_value, keep), "kind int, bin int, n long")
        return {(r.kind, r.bin): r.n for r in found.groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()}

    ordinary = lambda t: log_p(t, model)
    least = limits(counted(ordinary, lambda t: True), rate)
    discovered = lambda t: _bin(log_p(t, model)) >= least.get(length_class(len(t)), _MOST_BIN + 1)
    structured = limits(counted(battery_log_p, discovered), BATTERY_RATE)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for base, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["kind"], s["start"], s["stop"]) for s in base]
                for t in tokens:
                    a, b = t["start"], t["start"] + len(t["token"])
                    if any(x < b and a < y for _, x, y in spans):
                        continue
                    if discovered(t["token"]) and _bin(battery_log_p(t["token"])) < structured.get(length_class(b - a), _MOST_BIN + 1):
                        spans.append((OPAQUE, a, b))
                every.append([{"kind": k, "start": a, "stop": b} for k, a, b in in_order(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, span)], ["doc_id", "base", "spans"])

    schema = "doc_id long, base array<struct<kind:string,start:int,stop:int>>, spans array<struct<kind:string,start:int,stop:int>>"
    return table.where("base IS NOT NULL").select("doc_id", "base", "tokens").mapInArrow(judge, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from scan()."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[n(k) for k in (ASSIGN, ACCESS, HEX)], F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
