"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text is described by a dozen statistics of its characters, words and lines. The two classes get normal densities whose
covariances are shrunk towards the common one and towards a multiple of the identity; a text's score is the logistic of
the difference of its log densities (Mahalanobis distances by cached Cholesky factors) and the log odds of the classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, id_back, id_columns, small_batches, written

#: Shrinkage towards the common covariance and towards the identity; a temper below 1 allows for statistics that are no
#: independent normals; standardised statistics are clipped.
POOL, RIDGE, TEMPER, CLIP, THRESHOLD = 0.1, 0.02, 0.5, 6.0, 0.3
STATISTICS = ["words", "word_length", "long_words", "capitals", "digits", "marks", "odd_marks", "distinct", "repeats", "top_word", "lines", "repeated_lines", "sentence"]
D = len(STATISTICS)


@cache
def _kinds() -> np.ndarray:
    """For each code point: 0 odd mark, 1 letter, 2 capital, 3 digit, 4 white space, 5 usual mark."""
    usual = set(".,;:'\"!?-()")
    kind = lambda c: 4 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 5 if c in usual else 0
    return np.array([kind(chr(c)) for c in range(0x110000)], np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty, and a text without words has zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * D
    w, counts = len(words), Counter(words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    n = np.bincount(_kinds()[points], minlength=6)
    some, marks = len(points), n[0] + n[5]
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        np.log1p(w),
        np.log((n[1] + n[2] + 1) / w),
        np.sqrt(sum(len(x) > 12 for x in words) / w),
        np.sqrt(n[2] / some),
        np.sqrt(n[3] / some),
        np.sqrt(marks / some),
        np.sqrt(n[0] / some),
        np.log(len(counts) / w) + 0.12 * np.log1p(w),
        np.sqrt(same / w),
        np.sqrt(max(counts.values()) / w),
        np.log1p(len(lines)) - 0.5 * np.log1p(w),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.log(w / (1 + ends)),
    ]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "none": b["none"], "text_md5": b["text_md5"], "x": [[float(v) for v in statistics(t)] for t in b["text"]]})


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, text_md5, x, held_out) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*id_columns(), F.md5(text.cast("binary")).alias("text_md5"), text.alias("text"))
    out = rows.mapInPandas(_describe, "id long, none boolean, text_md5 string, x array<double>").select(id_back(), "text_md5", "x")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    with small_batches(docs.sparkSession):
        return written(out.withColumn("held_out", fold == 0), "described")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, 1 + D + D * D))
    for b in batches:
        for c in (0, 1):
            x = np.array(b["x"][b["quality"] == c].tolist()).reshape(-1, D)
            total[c] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    yield pd.DataFrame({"quality": np.repeat([0, 1], total.shape[1]), "k": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})


@dataclass
class Discriminant:
    """Class densities in standardised statistics; `low` holds the inverses of the Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    low: np.ndarray
    shift: float
    even: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.full(len(x), self.even)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        far = [(((z - m) @ low.T) ** 2).sum(1) for m, low in zip(self.mean, self.low, strict=True)]
        return 1 / (1 + np.exp(-np.clip(TEMPER * ((far[0] - far[1]) / 2 + self.shift), -50, 50)))


def fit(rows: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """rows: (x, quality 0 or 1). Two classes' moments, a few hundred numbers, come to the driver. With fewer than two
    rows of a class no density can be fitted: every score is then the share of class 1, both counted once more."""
    sums = rows.mapInPandas(_moments, "quality int, k int, v double").groupBy("quality", "k").agg(F.sum("v").alias("v"))
    m = np.zeros((2, 1 + D + D * D))
    for r in sums.collect():
        m[r.quality, r.k] = r.v
    n = m[:, 0]
    even = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(np.zeros(D), np.ones(D), np.zeros((0, D)), np.zeros((0, D, D)), 0.0, even)
    mean = m[:, 1 : 1 + D] / n[:, None]
    cov = m[:, 1 + D :].reshape(2, D, D) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    share = n / n.sum()
    centre = share @ mean
    scale = np.sqrt(np.maximum(share @ (np.diagonal(cov, axis1=1, axis2=2) + (mean - centre) ** 2), 1e-12))
    mean, cov = (mean - centre) / scale, cov / scale[:, None] / scale[None, :]
    common = np.tensordot(share, cov, 1)
    cov = (1 - ridge) * ((1 - pool) * cov + pool * common) + ridge * np.eye(D)
    chol = np.linalg.cholesky(cov)
    half = np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
    return Discriminant(centre, scale, mean, np.linalg.inv(chol), float(half[0] - half[1] + np.log(n[1] / n[0])), even)


def _score(model: Discriminant):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist()).reshape(-1, D)
            yield b[["id", "none", "text_md5", "held_out"]].assign(score=model.score(x))

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_md5, held_out, score, predicted), one row per row of docs.

    The labels (doc_id, quality) of rows that are not held out are fitted; a repeated label counts once, by its greater
    value, other values and null ids not at all. Null and empty texts get a score as any other; repeated rows get equal
    scores. Columns of any other name are ignored; without labels every score is 0.5.
    """
    x = described(docs)
    rows = x.select(*id_columns(), "text_md5", "held_out", "x")
    got = rows.mapInPandas(_score(_fit(x, labels)), "id long, none boolean, text_md5 string, held_out boolean, score double")
    return got.select(id_back(), "text_md5", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return fit(x.where(~F.col("held_out")).join(marks.hint("merge"), "doc_id").select("x", "quality"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose score reaches the threshold. A row finds its score by its id, null too, and its
    text's MD5, so repeated rows stay or go together and each text is described once."""
    id_, md5 = free_names(docs, "__id", "__md5")
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    fine = classify(docs, labels, threshold).where("predicted = 1").select(key.alias(id_), F.col("text_md5").alias(md5)).distinct()
    at = docs.withColumns({id_: key, md5: F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    return at.join(fine.hint("shuffle_hash"), [id_, md5], "left_semi").drop(id_, md5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels).drop("text_md5")
