"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams with case folded and everything but letters turned into spaces. Each n-gram is
hashed to a bucket with an embedding; the text is the mean of its embeddings, and a linear softmax over it gives the
languages. The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents,
PER_LANGUAGE of each language, chosen by a hash of doc_id. Executors reduce the sampled texts to bucket counts, so
what reaches the driver is bounded however long the texts are. Embeddings and softmax are linear, so for prediction
they are multiplied out into one integer table and a text is scored by table look-ups, in pieces of fixed size.

A part of the sample calibrates: a temperature makes the scores probabilities. Two criteria reject a document: its score,
and how usual its n-grams are in the language found, the mean of their log-frequencies in the sample against that of
calibration documents, in standard deviations at the text's length. Their limits are what all but REJECTED of the
calibration documents reach, those of the sample and up to CALIBRATED more of each language. Where these are too few for
that quantile, the limits are chance and UNUSUAL standard deviations; with fewer than
LEAST_CALIBRATED, n-grams reject nothing.

Defined results: null text, or text without a letter, gives `und` with score 0 and is rejected; without any labelled
document all rows are `und`; a null doc_id is not held out and not learned from; ties between languages go to the one
first in alphabetical order. Columns other than doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, durable, mark, trimmed
from .flat import flat_bytes

#: The bound of the training sample: documents of each language, and languages.
PER_LANGUAGE, MOST_LANGUAGES = 400, 500
REJECTED = 0.0005
#: Documents of each language beyond the sample that calibrate the rejection, and the limits for few of them.
CALIBRATED, LEAST_CALIBRATED, UNUSUAL = 1000, 50, -6.0
NGRAMS, BUCKET_BITS, DIMENSIONS = (2, 3, 4), 15, 8
_PIECE = 1 << 17
_EMBED_RATE, _DECAY = 10, 1e-4  # of embeddings against weights; of weights, so that they do not grow without end
_ASIDE = 5  # one in so many of the sample calibrates, by its place in a random order
_PARTS = 3  # rows of the sample for each document: the whole text and two stretches

_SPACED = np.full(256, 32, dtype=np.uint8)
_SPACED[128:] = np.arange(128, 256)
_SPACED[97:123] = np.arange(97, 123)


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, behind a space each, in lower case and with spaces for all but letters."""
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, starts = flat_bytes(pc.utf8_lower(pc.binary_join_element_wise(none, column.cast(pa.large_string()).fill_null(""), none, space)))
    return _SPACED[data], starts


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each byte that has one."""
    if len(data) < n:
        return np.zeros(0, dtype=np.uint32)
    value = np.full(len(data) - n + 1, n, dtype=np.uint32)
    for k in range(n):
        value *= np.uint32(0x01000193)
        value ^= data[k : len(data) - n + 1 + k]
    return (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, integers of 2**-16
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Log-frequencies in units like the table's, by language the usual mean, and the variance: constant, by 1 / n-grams.
    usual: np.ndarray
    center: np.ndarray | None = None
    variance: tuple[float, float] = (1.0, 0.0)
    unusual: float = -np.inf

    def means(self, column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean of the table's rows over each text's n-grams, and their number."""
        data, starts = _folded(column)
        rows, kinds = len(column), table.shape[1]
        sums, counts = np.zeros((rows, kinds), dtype=np.int64), np.zeros(rows, dtype=np.int64)
        for a in range(0, len(data), _PIECE):
            b = min(len(data), a + _PIECE)
            lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            for n in NGRAMS:
                bucket = _buckets(data[a : b + n - 1], n)
                begin = np.clip(starts[lo:hi], a, b)
                end = np.clip(np.minimum(starts[lo + 1 : hi + 1] - n + 1, a + len(bucket)), begin, b)
                some = np.flatnonzero(end > begin)
                if not len(some):
                    continue
                edges = np.stack([begin[some] - a, end[some] - a], axis=1).ravel()
                padded = np.concatenate([table[bucket], np.zeros((1, kinds), dtype=np.int32)])
                sums[lo + some] += np.add.reduceat(padded, edges, axis=0, dtype=np.int64)[::2]
                counts[lo + some] += (end - begin)[some]
        return sums / (65536.0 * np.maximum(counts, 1)[:, None]), counts

    def logits(self, column: pa.Array) -> np.ndarray:
        return self.means(column, self.table)[0] + self.bias

    def judged(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, the best language, the mean log-frequency in it, and the number of n-grams."""
        mean, count = self.means(column, np.concatenate([self.table, self.usual], axis=1))
        p = _softmax((mean[:, : len(self.languages)] + self.bias) / self.temperature) if len(column) else mean[:, : len(self.languages)]
        best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
        return p, best, mean[np.arange(len(p)), len(self.languages) + best], count

    def strangeness(self, best: np.ndarray, usual: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (usual - self.center[best]) / np.sqrt(self.variance[0] + self.variance[1] / np.maximum(count, 1))

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether a text is rejected."""
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), dtype=bool)
        letters = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        p, best, usual, count = self.judged(column)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        gone = ~letters | (score < self.threshold)
        if self.unusual > -np.inf:
            gone |= self.strangeness(best, usual, count) < self.unusual
        return [self.languages[k] if ok else "und" for k, ok in zip(best, letters)], score, gone


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from."""
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def _chosen(docs: DataFrame, last: int) -> DataFrame:
    """doc_id, lang, mark (a hash of the text) and place of the first documents of each language in a random order.

    Languages are counted first, and a document whose hash is beyond the share that the places need is left out before
    the rest are ordered: however many documents a language has, a few thousand rows of it are shuffled.
    """
    named = _learned(docs).select("doc_id", "lang", mark().alias("mark"))
    named = named.withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(20)))
    counts = durable(named.groupBy("lang").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "lang").limit(MOST_LANGUAGES))
    # Three times the places and more: fewer than the places are left over about never, and then all rows are ordered.
    share = F.least(F.lit(1.0), (3.0 * last + 300) / F.col("many"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "mark")

    def drawn(limit) -> DataFrame:
        some = named.join(F.broadcast(counts), "lang").where((F.col("draw") / 2.0**64 + 0.5) <= limit)
        once = some.groupBy("doc_id").agg(F.min(F.struct("lang", "mark", "draw", "many")).alias("x")).select("doc_id", "x.*")
        return durable(once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last))

    found = drawn(share)
    short = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.first("many").alias("many")).where((F.col("n") < last) & (F.col("many") > 3 * last + 300))
    # Repeated rows of few documents can leave too few as well.
    return (found if short.isEmpty() else drawn(F.lit(2.0))).select("doc_id", "lang", "mark", "place")


def _parts(doc: int, text: str) -> tuple[str, str, str]:
    every = text.split()
    at = doc * 7919 % max(1, len(every) - 29)
    return text, " ".join(every[at : at + 30]), " ".join(every[at : at + 8])


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, lang and text of the chosen documents, a row each."""
    named = _learned(docs).select("doc_id", "text").withColumn("mark", mark())
    found = named.join(F.broadcast(chosen), ["doc_id", "mark"])
    return found.groupBy("doc_id", "mark", "lang").agg(F.first("text").alias("text"), F.first("place").alias("place"))


def _sample(docs: DataFrame, chosen: DataFrame, per_language: int) -> DataFrame:
    """Bucket counts of the sampled documents, and of stretches of 30 and 8 words of each: short texts are to be known too."""
    rows = _texts(docs, chosen.where(F.col("place") <= per_language)).select("doc_id", "lang", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lang, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, part in enumerate(_parts(doc, text)):
                    data, _ = _folded(pa.array([part]))
                    count = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                    for n in NGRAMS:
                        for a in range(0, len(data), _PIECE):
                            count += np.bincount(_buckets(data[a : a + _PIECE + n - 1], n), minlength=len(count))
                    bucket = np.flatnonzero(count)
                    weight = (count[bucket] / max(1, count.sum())).astype("<f4")
                    out.append((doc, lang, place, k, bucket.astype("<u4").tobytes(), weight.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, kinds)], ["doc_id", "lang", "place", "part", "bucket", "weight"])

    return rows.mapInArrow(run, "doc_id long, lang string, place long, part long, bucket binary, weight binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 8, seed: int = 5) -> Model:
    """Fit on the documents that are not held out. A fifth of the sample is kept for calibration."""
    chosen = _chosen(docs, per_language + CALIBRATED)
    got = sorted(_sample(docs, chosen, per_language).collect(), key=lambda r: (r.doc_id, r.part))
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), dtype=np.int32), np.zeros(0), 1.0, 0.0, np.zeros((1 << BUCKET_BITS, 0), dtype=np.int32))
    known = {lang: k for k, lang in enumerate(languages)}
    x = [(np.frombuffer(r.bucket, "<u4").astype(np.int64), np.frombuffer(r.weight, "<f4").astype(np.float64)) for r in got]
    y = np.asarray([known[r.lang] for r in got])
    aside = np.asarray([r.place % _ASIDE == 0 for r in got])
    fit = np.flatnonzero(~aside)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weight, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = epochs * max(1, -(-len(fit) // 16)), 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // 16))):
            rate, done = 8.0 * (1 - done / steps), done + 1
            bucket, value = np.concatenate([x[k][0] for k in some]), np.concatenate([x[k][1] for k in some])
            owner = np.repeat(np.arange(len(some)), [len(x[k][0]) for k in some])
            mean = np.zeros((len(some), DIMENSIONS))
            for d in range(DIMENSIONS):
                mean[:, d] = np.bincount(owner, value * embed[bucket, d], len(some))
            slope = _softmax(mean @ weight + bias)
            slope[np.arange(len(some)), y[some]] -= 1
            slope /= len(some)
            back = slope @ weight.T
            # A bucket's share of a text is small, so its embedding moves at a higher rate.
            np.subtract.at(embed, bucket, _EMBED_RATE * rate * value[:, None] * back[owner])
            weight -= rate * (mean.T @ slope + _DECAY * weight)
            bias -= 0.1 * rate * slope.sum(axis=0)
    table = np.clip(np.rint(embed @ weight * 65536), -(2**31), 2**31 - 1).astype(np.int32)
    check = np.flatnonzero(aside) if aside.any() else fit
    logits = np.stack([(x[k][1][:, None] * (table[x[k][0]] / 65536.0)).sum(axis=0) + bias for k in check])
    # Smoothed targets, so that a separable calibration set does not drive the temperature to nothing.
    target = np.full(logits.shape, 1 / (len(check) + len(languages)))
    target[np.arange(len(check)), y[check]] = 1 - target[0, 0] * (len(languages) - 1)
    loss = lambda t: -(target * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean()
    temperature = float(min(np.geomspace(0.05, 5000, 121), key=loss))
    seen = np.zeros((1 << BUCKET_BITS, len(languages)))
    for k in fit:
        if k % _PARTS == 0:
            seen[x[k][0], y[k]] += x[k][1]
    # A millionth for buckets that the language's sample does not have.
    usual = np.rint(np.log(seen / np.maximum(seen.sum(axis=0), 1e-9) + 1e-6) * 65536).astype(np.int32)
    model = Model(languages, table, bias, temperature, 1.0 / len(languages), usual)
    return _calibrated(docs, model, chosen.where((F.col("place") > per_language) | (F.col("place") % _ASIDE == 0)))


def _calibrated(docs: DataFrame, model: Model, chosen: DataFrame) -> Model:
    """The limits of rejection from documents the model was not fitted on: those set aside and some not sampled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 300):
                doc, text = (c.to_pylist() for c in batch.slice(a, 300).columns)
                p, best, usual, count = model.judged(pa.array([x for d, t in zip(doc, text) for x in _parts(d, t)], pa.large_string()))
                part = np.tile(np.arange(_PARTS), len(doc))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, p.max(axis=1), best.astype(np.int64), usual, count)], ["part", "p", "best", "usual", "n"])

    texts = _texts(docs, chosen).where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text")
    # At most three rows of numbers a document reach the driver.
    rows = texts.mapInArrow(run, "part long, p double, best long, usual double, n long").toPandas()
    part, p, best, usual, count = (rows[c].to_numpy() for c in ("part", "p", "best", "usual", "n"))
    whole = part == 0
    n = int(whole.sum())
    rank = int(REJECTED * (n + 1))
    if rank:
        model.threshold = max(float(np.sort(p[whole])[rank - 1]), 1.0 / len(model.languages))
    if n >= LEAST_CALIBRATED:
        of = [usual[whole & (best == k)] for k in range(len(model.languages))]
        model.center = np.asarray([x.mean() if len(x) else usual[whole].mean() for x in of])
        square, m = (usual - model.center[best]) ** 2, np.maximum(count, 1)
        slope = max(1e-9, float((square * m)[~whole].mean()))
        model.variance = (max(1e-9, float((square - slope / m)[whole].mean())), slope)
        strange = np.sort(model.strangeness(best, usual, count)[whole])
        model.unusual = float(strange[rank - 1] if rank else UNUSUAL)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                lang, score, gone = model.decide(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return columns(docs, "doc_id", "text").mapInArrow(lambda b: trimmed(run(b)), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows that are not rejected, all columns as they are."""
    model = model or train(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield part.filter(pa.array(~model.decide(part.column(place))[2], pa.bool_()))

    return docs.mapInArrow(lambda b: trimmed(run(b)), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
