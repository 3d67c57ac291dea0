"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): one vector of weights on hashed text features is shared by all grades,
and ordered thresholds cut its line into grades. The fit uses a bounded sample of labelled documents; every document
gets its expected grade and the probability of reaching the grade that selection asks for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import BoundedCache, documents, hashed_sample, map_arrow, slices

BUCKETS = 1 << 19
#: The labelled documents that a fit uses at most: those with the smallest hash of their id.
MAX_LABELLED = 12_000
#: Words also count by their beginning of so many characters.
PREFIX = 5
GRADES = 3  # 0 toxic, 1 poor, 2 good
ACCEPT = 2
_TOKEN = re.compile(r"\w+|[^\w\s]+")
SCORES = "doc_id long, expected_grade double, tail_probability double, keep boolean"


def bucket_of(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode(), 17) % BUCKETS


class Hasher:
    """The distinct buckets of a whole text: its lower-case tokens, their beginnings, and a few facts on its shape."""

    def __init__(self):
        self.bucket = BoundedCache(bucket_of)

    def features(self, text: str) -> set[int]:
        tokens = _TOKEN.findall(text.lower())
        distinct = set(tokens)
        found = set(map(self.bucket.__getitem__, distinct))
        found.update(map(self.bucket.__getitem__, {f"\0{t[:PREFIX]}" for t in distinct if len(t) > PREFIX}))
        lines = text.split("\n")
        shape = ("symbols", 10 * sum(map(len, (t for t in tokens if not t[0].isalnum()))) // max(1, len(text))), ("lines", 5 * len(set(lines)) // len(lines)), ("size", len(tokens).bit_length())
        return found | {self.bucket[f"\0{k}={v}"] for k, v in shape}


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, by bucket
    thresholds: np.ndarray  # ascending, GRADES - 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tails(score).sum(axis=1)

    def tail(self, score: np.ndarray, grade: int = ACCEPT) -> np.ndarray:
        return self.tails(score)[:, grade - 1] if grade else np.ones_like(score)


def fit(rows: list[tuple[np.ndarray, int]], grades: int = GRADES, rounds: int = 200, penalty: float = 1e-3, min_docs: int = 3, rate: float = 0.05) -> OrdinalModel:
    """Maximum penalised likelihood by full-batch Adam. rows: (distinct buckets, grade). Buckets of under ``min_docs`` rows weigh nothing.

    Without rows, or with one grade only, the thresholds alone are learnt.
    """
    edges = np.arange(1, grades)
    if not rows:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), edges - grades / 2.0)
    sizes = np.array([len(x) for x, _ in rows])
    columns, owner = np.concatenate([x for x, _ in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    y = np.array([g for _, g in rows])
    often = np.flatnonzero(np.bincount(columns, minlength=BUCKETS) >= min_docs)
    slot = np.full(BUCKETS, -1)
    slot[often] = np.arange(len(often))
    use = slot[columns] >= 0
    columns, owner = slot[columns[use]], owner[use]
    above = np.array([(y >= k).mean() for k in edges]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    # thresholds = first, then first plus positive gaps
    theta = np.concatenate([np.zeros(len(often)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = 1 / np.bincount(y, minlength=grades).clip(1) ** 0.5  # rarer grades count more
    weight = (share / share[y].mean())[y]
    for t in range(1, rounds + 1):
        w, cut = theta[: len(often)], theta[len(often)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(often) + 1 :]))])
        s = np.bincount(owner, weights=w[columns], minlength=len(rows))
        below = 1 / (1 + np.exp(-np.clip(cut[None, :] - s[:, None], -60, 60)))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(rows), 1)), below * (1 - below), np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        p = np.maximum(full[at, y + 1] - full[at, y], 1e-9)
        up, low = weight * slope[at, y + 1] / p, weight * slope[at, y] / p  # d loglik / d upper cut, d lower cut
        g_s = (low - up) / len(rows)
        g_cut = np.array([(np.where(y == k, up, 0) - np.where(y == k + 1, low, 0)).sum() for k in range(grades - 1)]) / len(rows)
        gaps = np.exp(theta[len(often) + 1 :])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = -np.concatenate([np.bincount(columns, weights=g_s[owner], minlength=len(often)), tail[:1], tail[1:] * gaps])
        grad[: len(often)] += penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[often] = theta[: len(often)]
    return OrdinalModel(weights, theta[len(often)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(often) + 1 :]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row an id: the worst of its labels. Rows without id or label have none."""
    rated = labels.dropna(subset=["doc_id", "quality"]).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return rated.agg(grade_of(F.min("quality"), F.max(F.coalesce("toxic", F.lit(0)))).alias("grade"))


def labelled_features(docs: DataFrame, grades: DataFrame, most: int = MAX_LABELLED) -> list[tuple[np.ndarray, int]]:
    """Features and grade of at most ``most`` labelled documents, collected. The broadcast holds ``most`` ids. Of rows that share
    a doc_id, the one whose text has the smallest hash is taken, so that a repeated document weighs no more than another."""
    sample = hashed_sample(grades, "doc_id", most)
    found = documents(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    chosen = found.select("doc_id", F.col("first.text").alias("text"), "grade")

    def work(batches):
        hasher = Hasher()
        for batch in slices(batches):
            yield {"doc_id": batch.column("doc_id"), "x": [np.array(sorted(hasher.features(t)), dtype=np.int32).tobytes() for t in batch.column("text").to_pylist()], "grade": batch.column("grade")}

    rows = map_arrow(chosen, work, "doc_id long, x binary, grade int").collect()
    return [(np.frombuffer(bytes(r["x"]), dtype=np.int32), r["grade"]) for r in sorted(rows, key=lambda r: (r["doc_id"], bytes(r["x"])))]


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> OrdinalModel:
    return fit(labelled_features(docs, graded(labels), most))


class Scorer:
    def __init__(self, model: OrdinalModel):
        self.model, self.hasher = model, Hasher()

    def score(self, texts: list[str]) -> np.ndarray:
        w = self.model.weights
        return np.array([float(w[np.fromiter(self.hasher.features(t), dtype=np.int64)].sum(dtype=np.float64)) for t in texts], dtype=np.float64)


def quality_scores(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, grade: int = ACCEPT) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every whole text; keep: P(grade >= ``grade``) >= ``threshold``.

    Null texts are scored as empty; repeated rows give a row each; an empty table gives none; extra columns are left
    behind. One pass without a shuffle; the weights (2 MB) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            s = scorer.score(batch.column("text").to_pylist())
            tail = shared.value.tail(s, grade)
            yield {"doc_id": batch.column("doc_id"), "expected_grade": shared.value.expected(s).round(6), "tail_probability": tail.round(6), "keep": tail >= threshold}

    return map_arrow(documents(docs), work, SCORES)


def select_quality(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, grade: int = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose documents quality_scores() keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keep = shared.value.tail(scorer.score(texts), grade) >= threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
