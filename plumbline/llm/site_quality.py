"""Document quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier on the make-up of a text (letters, capitals, digits, symbols, spacing, word length, repetition)
gives each document a probability of being good. It is fitted in numpy on a bounded sample of labelled documents, chosen
by a hash of doc_id. The probabilities are then summed by path and by host. Rates of hosts are drawn to the global rate
and rates of paths to their host's, each with a strength estimated from the data by the method of moments over all
groups: the noisier a rate is against the spread between groups, the more it is shrunk. A document's score adds the
log-odds of its path, against the global rate, times `site_weight`, to its own log-odds. The document itself is left out
of the sums of its path and of its host. Host and path may be any columns; site() reads them off a URL.

Sums are partial sums before the shuffle, so a host with a third of all rows is one row per task. Group tables are
broadcast below a counted size and joined by a shuffle beyond it.

Defined results: null or empty text has the features of a text without characters; null host or path is a group of its
own; without labels of both kinds every document's own probability is one half; of repeated labels for a doc_id the mean
counts, from one half up as good; repeated rows are scored like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .flat import IS_SPACE, flat_bytes, words

#: The bound of the labelled sample, and of group tables that may be broadcast (under 100 bytes a row).
LABELLED, BROADCAST_ROWS = 4000, 100_000
SITE_WEIGHT, KEEP_FROM = 0.5, 0.5

_KINDS = np.zeros((256, 5))
_KINDS[97:123, 0] = _KINDS[65:91, 0] = _KINDS[128:, 0] = 1
_KINDS[65:91, 1] = 1
_KINDS[48:58, 2] = 1
_KINDS[33:48, 3] = _KINDS[58:65, 3] = _KINDS[91:97, 3] = _KINDS[123:127, 3] = 1
_KINDS[[44, 46], 3] = 0
_KINDS[IS_SPACE, 4] = 1
_KINDS = _KINDS.astype(np.float32)
N_FEATURES = 8


def features(column: pa.Array) -> np.ndarray:
    """Shares of letters, capitals, digits, symbols and spaces, log length, mean word length, share of distinct words."""
    out = np.zeros((len(column), N_FEATURES))
    step = 200
    for k in range(0, len(column), step):
        data, starts = flat_bytes(column.slice(k, step))
        size = np.diff(starts)
        word, first, _ = words(data, starts)
        for row in range(len(size)):
            n = size[row]
            if not n:
                continue
            count = np.bincount(data[starts[row] : starts[row + 1]], minlength=256) @ _KINDS
            mine = word[first[row] : first[row + 1]]
            out[k + row, :5] = count / n
            out[k + row, 5:] = np.log1p(n) / 10, (n - count[4]) / max(1, len(mine)) / 10, len(np.unique(mine)) / max(1, len(mine))
    return out


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms((x - self.mean) / self.spread) @ self.weight, -30, 30)))


def _terms(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.column_stack([np.ones(len(z)), z, z * z])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Ridge-penalised logistic regression by Newton's method."""
    if len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(1 + 2 * N_FEATURES), 0.5)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    a = _terms((x - mean) / spread)
    w, pull = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    pull[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, spread, w, float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Classifier:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "good"])

    got = sorted(rows.select("doc_id", "text", "_good").mapInArrow(run, "doc_id long, x array<double>, good int").collect(), key=lambda r: r.doc_id)
    return fit(np.asarray([r.x for r in got]).reshape(-1, N_FEATURES), np.asarray([float(r.good) for r in got]))


def evidence(docs: DataFrame, model: Classifier, host: Column, path: Column) -> DataFrame:
    """A written table of doc_id, host, path and p_doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(features(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], ["doc_id", "host", "path", "p_doc"])

    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    return written(rows.mapInArrow(run, "doc_id long, host string, path string, p_doc double"), "evidence")


def site(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host in lower case without www, user and port, and the host with the first part of the
    path. Null where the text is no absolute URL of http."""
    whole = r"^(?i:https?)://(?:[^/?#@]*@)?(?i:www\.)?([^/?#:@]+)(?::\d*)?(?:/([^/?#]*))?"
    host = F.lower(F.nullif(F.regexp_extract(url, whole, 1), F.lit("")))
    return host, F.concat_ws("/", host, F.regexp_extract(url, whole, 2))


def _strength(groups: DataFrame, center: Column) -> tuple[float, int]:
    """Prior observations of groups with n, sum, squares around their centers; and how many groups there are."""
    rate = F.col("sum") / F.col("n")
    r = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("squares") - F.col("n") * rate * rate).alias("within"), F.sum(F.col("n") * (rate - center) ** 2).alias("between"),
    ).first()
    if not r.groups:
        return 1.0, 0
    noise = max(1e-6, r.within / max(1, r.n - r.groups))
    spread = (r.between - (r.groups - 1) * noise) / max(1.0, r.n - r.nn / r.n)
    return float(np.clip(noise / max(spread, 1e-9), 1.0, 1e6)), r.groups


def _sums(df: DataFrame, *by: str) -> DataFrame:
    p = F.col("p_doc")
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("sum"), F.sum(p * p).alias("squares"))


def posteriors(table: DataFrame) -> tuple[DataFrame, float]:
    """host, path, the sums of the path and of the host, p_host, the prior strengths of both; and the global rate."""
    paths = written(_sums(table, "host", "path"), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")])
    total = hosts.agg(F.sum("sum"), F.sum("n")).first()
    mean = float(total[0] / total[1]) if total[1] else 0.5
    host_strength, n_hosts = _strength(hosts, F.lit(mean))
    p_host = (F.col("sum") + host_strength * mean) / (F.col("n") + host_strength)
    hosts = hosts.select(F.col("host").alias("_host"), p_host.alias("p_host"), F.col("n").alias("host_n"), F.col("sum").alias("host_sum"))
    if n_hosts <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    both = paths.join(hosts, paths["host"].eqNullSafe(F.col("_host"))).drop("_host")
    path_strength, n_paths = _strength(both, F.col("p_host"))
    both = both.withColumns({"strength": F.lit(path_strength), "host_strength": F.lit(host_strength)})
    return (F.broadcast(both) if n_paths <= BROADCAST_ROWS else both), mean


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, site_weight: float = SITE_WEIGHT, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, p_doc, p_host and p_path (both without the document itself), score and keep of every row."""
    return scored(evidence(docs, train(docs, labels), host, path), site_weight, keep_from)


def scored(table: DataFrame, site_weight: float = SITE_WEIGHT, keep_from: float = KEEP_FROM) -> DataFrame:
    """The columns of score() from rows of doc_id, host, path and p_doc."""
    groups, mean = posteriors(table)
    groups = groups.withColumnsRenamed({"host": "_host", "path": "_path"})
    df = table.join(groups, table["host"].eqNullSafe(F.col("_host")) & table["path"].eqNullSafe(F.col("_path")))
    p_host = (F.col("host_sum") - F.col("p_doc") + F.col("host_strength") * mean) / (F.col("host_n") - 1 + F.col("host_strength"))
    df = df.withColumn("p_host", p_host)
    p_path = (F.col("sum") - F.col("p_doc") + F.col("strength") * F.col("p_host")) / (F.col("n") - 1 + F.col("strength"))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    df = df.withColumn("p_path", p_path)
    total = odds(F.col("p_doc")) + site_weight * (odds(F.col("p_path")) - odds(F.lit(mean)))
    df = df.withColumn("score", 1 / (1 + F.exp(-total)))
    return df.select("doc_id", "p_doc", "p_host", "p_path", "score", (F.col("score") >= keep_from).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
