"""Quality by hierarchical empirical Bayes: a text classifier's evidence and what sites are like."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.text import WORD, chunks, utf8, words
from echoframe.session import checkpointed

#: Labelled documents that the classifier is fitted on: what the driver holds is bounded by it.
SAMPLE = 6_000

#: Word classes by hash, and the smallest standard score of a class that the classifier uses.
BUCKETS, STANDARD_SCORE = 1 << 18, 4.0

#: Bounds of the number of documents that a prior counts for.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1_000.0

SHAPES = 6


def _shapes(data: np.ndarray, at: np.ndarray, n_words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Shares of capitals, marks, digits and line breaks, length of words, and share of distinct words."""
    upper = ((data >= 0x41) & (data <= 0x5A)).astype(np.int64)
    digit = ((data >= 0x30) & (data <= 0x39)).astype(np.int64)
    line = (data == 0x0A).astype(np.int64)
    mark = ((WORD[data] == 0) & (data > 0x20)).astype(np.int64)
    size = np.maximum(np.diff(at), 1)
    sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[at]) / size for x in (upper, mark, digit, line)]
    length = np.diff(np.concatenate(([0], np.cumsum(WORD[data] > 0)))[at]) / np.maximum(n_words, 1)
    return np.stack([*sums, length / 10, distinct / np.maximum(n_words, 1)], axis=1)


def _look(column):
    """By stretches: first and last text, shapes, and (text, word class) of every distinct class of a text."""
    data, at = utf8(column)
    for lo, hi in chunks(at):
        part, own = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        h, _, _, before = words(part, own)
        text = np.repeat(np.arange(hi - lo), np.diff(before))
        pair = np.unique(text * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64))
        of, bucket = np.divmod(pair, BUCKETS)
        yield lo, hi, _shapes(part, own, np.diff(before), np.bincount(of, minlength=hi - lo)), of, bucket


@dataclass
class Classifier:
    """Log-odds from word classes and shapes."""

    buckets: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    bias: float

    def log_odds(self, shapes: np.ndarray, of: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        z = ((shapes - self.mean) / self.scale).clip(-8, 8) @ self.shape_weights + self.bias
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            z += np.bincount(of[hit], self.weights[at[hit]], minlength=len(z))
        return z.clip(-12, 12)


def train(shapes: np.ndarray, of: np.ndarray, bucket: np.ndarray, y: np.ndarray, steps: int = 400) -> Classifier:
    """Logistic regression on shapes and on the word classes that tell the labels apart."""
    n, good = len(y), float(y.sum())
    seen = np.bincount(bucket, minlength=BUCKETS)
    with_good = np.bincount(bucket, y[of], minlength=BUCKETS)
    p = (seen + 1) / (n + 2)
    gap = with_good / max(good, 1) - (seen - with_good) / max(n - good, 1)
    score = np.abs(gap) / np.sqrt(p * (1 - p) * (1 / max(good, 1) + 1 / max(n - good, 1)))
    keep = np.flatnonzero((score > STANDARD_SCORE) & (seen >= 5))
    mean, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
    s = ((shapes - mean) / scale).clip(-8, 8)
    at = np.minimum(np.searchsorted(keep, bucket), max(len(keep) - 1, 0))
    hit = keep[at] == bucket if len(keep) else np.zeros(len(bucket), bool)
    rows, cols = of[hit], at[hit]
    w, v, b = np.zeros(len(keep)), np.zeros(SHAPES), np.log((good + 1) / (n - good + 1))
    parts = [w, v, np.array([b])]
    first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for step in range(1, steps + 1):
        z = s @ parts[1] + parts[2] + np.bincount(rows, parts[0][cols], minlength=n)
        e = 1 / (1 + np.exp(-z.clip(-30, 30))) - y
        grads = [np.bincount(cols, e[rows], minlength=len(keep)) / n + 1e-4 * parts[0], s.T @ e / n + 1e-4 * parts[1], np.array([e.mean()])]
        for x, g, a, c in zip(parts, grads, first, second):
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    return Classifier(keep, parts[0], mean, scale, parts[1], float(parts[2][0]))


def fit(labelled: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Classifier | None:
    """Train on ``sample`` labelled rows (label 0 or 1) at most; None without any.

    Rows are drawn by a hash of their key and text, so one key for many draws like many keys; rows equal in key,
    text and label count once.
    """
    own = F.col(f"`{text}`").cast("string")
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1)).select(
        F.xxhash64(F.col(f"`{key}`"), own).alias("key"), own.alias("text"),
        F.col(f"`{label}`").cast("double").alias("label"))
    n = rows.count()
    if not n:
        return None
    def look(batches):
        for b in batches:
            for lo, hi, shapes, of, bucket in _look(b.column(1)):
                edges = np.searchsorted(of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                    pa.array([r.tobytes() for r in shapes], pa.binary()),
                    pa.array([bucket[x:y].astype(np.int32).tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())],
                    names=["key", "label", "shapes", "buckets"])

    def drawn(share: float) -> list:
        chosen = rows.where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20))
        seen = chosen.mapInArrow(look, "key long, label double, shapes binary, buckets binary")
        return seen.dropDuplicates(["key", "label"]).orderBy("key", "label").limit(sample).collect()

    # Somewhat more than wanted, of which the first are taken; all of them if chance leaves none.
    got = drawn(min(1.0, 1.2 * sample / n)) or drawn(1.0)
    got.sort(key=lambda r: (r["key"], r["label"], bytes(r["shapes"])))
    own = [np.frombuffer(r["buckets"], np.int32) for r in got]
    return train(np.array([np.frombuffer(r["shapes"]) for r in got]), np.repeat(np.arange(len(got)), [len(b) for b in own]),
                 np.concatenate(own).astype(np.int64), np.array([r["label"] for r in got]))


def text_log_odds(df: DataFrame, text: str, models: dict[str, Classifier | None]) -> DataFrame:
    """``df`` without ``text`` and with a column of log-odds for each model; null texts are empty."""
    rest, names = [c for c in df.columns if c != text], list(models)
    place = df.columns.index(text)

    def rows(batches):
        for b in batches:
            out = {m: np.zeros(b.num_rows) for m in names}
            for lo, hi, shapes, of, bucket in _look(b.column(place)):
                for m, model in models.items():
                    if model is not None:
                        out[m][lo:hi] = model.log_odds(shapes, of, bucket)
            kept = [b.column(i) for i in range(b.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[m]) for m in names)], names=[*rest, *names])

    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(m, T.DoubleType()) for m in names])
    return df.mapInArrow(rows, schema)


def host_of(url: Column) -> Column:
    """Host of a web address, in lower case and without ``www.``; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path_of(url: Column) -> Column:
    """First step of a web address's path."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]*)", 1)


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many documents a prior counts for, from how much groups differ (method of moments).

    With groups of mean m_g over n_g documents around a prior mean m, the excess of the squared deviations
    over what chance gives, m (1 - m) / n_g, is the variance of the groups themselves.
    """
    d = groups.where("n >= 2").withColumn("m", mean).agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)), F.sum(F.col("m") * (1 - F.col("m"))),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))), F.sum("n"), F.count("*")).head()
    squares, noise, spread, n, count = (float(x or 0) for x in d)
    if count < 2 or squares <= noise or not spread:
        return MOST_PRIOR
    excess = (squares - noise) / n  # variance between groups
    return float(np.clip(spread / n / max(excess, 1e-9) - 1, LEAST_PRIOR, MOST_PRIOR))


def site_posteriors(scored: DataFrame, host: str, path: str, evidence: str) -> DataFrame:
    """Every row with ``site``: log-odds of its site against the whole corpus, without the row's own evidence.

    Evidence is a probability (or a label).  Sites are Beta posteriors: a host's prior is the corpus's
    mean, a path's prior is its host's posterior mean, and both priors count for as many documents as the
    groups' spread suggests; few documents move a site little.  Null hosts or paths are a group of their own.
    """
    by = scored.withColumns({"_h": F.coalesce(F.col(host), F.lit("")), "_p": F.coalesce(F.col(path), F.lit(""))})
    # Sums within tasks first: a host with a third of all rows sends one row from each.
    paths = checkpointed(by.groupBy("_h", "_p").agg(F.sum(evidence).alias("good"), F.count("*").alias("n")))
    hosts = paths.groupBy("_h").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).head()
    mean = float(np.clip((total[0] or 0) / max(total[1] or 1, 1), 1e-3, 1 - 1e-3))
    host_prior = _strength(hosts, F.lit(mean))
    with_host = paths.join(hosts.select("_h", F.col("good").alias("hg"), F.col("n").alias("hn")), "_h")
    host_mean = (F.col("hg") + host_prior * mean) / (F.col("hn") + host_prior)
    path_prior = _strength(with_host, host_mean)
    own = F.col(evidence)
    # The row itself is taken out of its host and its path.
    h = (F.col("hg") - own + host_prior * mean) / (F.col("hn") - 1 + host_prior)
    p = (F.col("good") - own + path_prior * h) / (F.col("n") - 1 + path_prior)
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    site = F.log(p / (1 - p)) - F.lit(float(np.log(mean / (1 - mean))))
    return by.join(with_host, ["_h", "_p"]).withColumn("site", site).drop("_h", "_p", "good", "n", "hg", "hn")


def classify(docs: DataFrame, key: str, text: str, host: Column, path: Column, labels: DataFrame, label_key: str,
             names: list[str]) -> DataFrame:
    """key, and for each label: its log-odds by the text, by the site, and its probability.

    The classifier is fitted on a bounded sample of labelled documents and applied to all.  A document's
    evidence for its site is its label where it has one, else the classifier's probability.  Its own
    probability adds the classifier's log-odds to those of its site.

    Null texts are empty texts; null keys have no label.  Of several labels for one key the mean
    counts.  Repeated rows get a row each.  Without labels every probability is a half for all.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                       host.cast("string").alias("host"), path.cast("string").alias("path"))
    one = labels.groupBy(F.col(f"`{label_key}`").alias("key")).agg(*[F.avg(f"`{n}`").alias(n) for n in names])
    models = {n: fit(docs.join(one, "key"), "key", "text", n) for n in names}
    # Texts are read once more and never again: the rest works on a few numbers for each document.
    out = checkpointed(text_log_odds(docs, "text", {f"{n}_text": m for n, m in models.items()}).join(one, "key", "left"))
    for n in names:
        evidence = F.coalesce(F.col(n), 1 / (1 + F.exp(-F.col(f"{n}_text"))))
        out = site_posteriors(out.withColumn("_e", evidence), "host", "path", "_e").withColumnRenamed("site", f"{n}_site").drop("_e")
    return out.select("key", *[c for n in names for c in (
        f"{n}_text", f"{n}_site", (1 / (1 + F.exp(-(F.col(f"{n}_text") + F.col(f"{n}_site"))))).alias(f"{n}_probability"))])
