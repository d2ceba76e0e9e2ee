"""Quality by Bradley-Terry pairwise ranking.

Every text has a strength, a weighted sum of features of its surface; that of two texts the one labelled good is preferred has
the logistic probability of the difference of their strengths. The weights are fitted to preference pairs by the logistic
loss on differences of features (with a small ridge on standardised features): each text of the sample meets ``PARTNERS`` of
the other class, dealt evenly. The sample holds the labelled rows of each class with the least hashes, ``PAIR_ROWS`` at most; only
their features, never their texts, come to the driver.

A strength has no natural zero, so the threshold is a quantile: that share of *all* labelled rows outside the held-out fold
which is labelled poor lies below it (exactly up to ``QUANTILE_ROWS`` rows, beyond that within a rank of one in as many).
The score is the logistic function of the strength, placed so that the threshold scores ``CUT``.

Features are rates, so they do not grow with a text: of words in capitals, without letters, with doubled signs at their end;
of words equal to the one before them, of repeated pairs of words; of characters that are signs, digits or capitals; and the
length of words. They are counted for the distinct words of a slice at once and gathered as arrays, in linear time.

A null or empty text, like any without words, has no features; its score is the smoothed share of good labels, as is every
score where the labels lack a class. Ties of hashes go by the id. Repeated rows are scored alike, each; a document labelled
twice counts as good if either label does. Empty tables give no rows. Only ``doc_id``, ``text`` and the labels' ``doc_id`` and
``quality`` are read; a column with the name of the result is replaced by it, all others stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.toxicity import HELD_OUT, fold
from tidemark.llm.words import Slice, slices

#: Rows of each class in the sample that pairs are made of, and pairs for each row of it.
PAIR_ROWS = 10_000
PARTNERS = 16
QUANTILE_ROWS = 200_000
#: What the threshold scores, so that predicted = score >= CUT.
CUT = 0.3
FEATURES = ("capitals", "bare", "doubled", "stutter", "repeated", "signs", "digits", "upper", "length", "long_words")


def _of_words(words: list[str]) -> np.ndarray:
    """For each word: capitals, bare, doubled, letters upper, signs, digits, length, whether it is long."""
    out = np.zeros((len(words), 8))
    for i, w in enumerate(words):
        n = len(w)
        if not n:
            continue
        if w.isalpha():
            upper = 0 if w.islower() else sum(map(str.isupper, w))
            out[i] = (n > 1 and upper == n, 0, 0, upper, 0, 0, n, n > 20)
            continue
        letters, digits = sum(map(str.isalpha, w)), sum(map(str.isdigit, w))
        upper = sum(map(str.isupper, w))
        out[i] = (letters > 1 and upper == letters, letters == 0, n > 1 and not w[-1].isalnum() and not w[-2].isalnum(), upper, n - letters - digits, digits, n, n > 20)
    return out


def _features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text of a slice and its FEATURES; zeros for a text without words."""
    each = _of_words(s.words)
    filled = np.array([bool(w) for w in s.words], bool)[s.codes]  # white space at either end leaves an empty word
    row = np.repeat(np.arange(len(s.texts)), np.diff(s.starts))[filled]
    codes = s.codes[filled].astype(np.int64)
    n = np.bincount(row, minlength=len(s.texts))
    capitals, bare, doubled, upper, signs, digits, chars, long_words = (np.bincount(row, x[codes], len(n)) for x in each.T)
    inside = row[1:] == row[:-1]
    at = row[1:][inside]
    first, second = codes[:-1][inside], codes[1:][inside]
    stutter = np.bincount(at, first == second, len(n))
    order = np.lexsort((second, first, at))
    a, f, g = at[order], first[order], second[order]
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (f[1:] == f[:-1]) & (g[1:] == g[:-1])
    repeated = np.bincount(a, again, len(n))
    w, p, c = np.maximum(n, 1), np.maximum(n - 1, 1), np.maximum(chars, 1)
    rates = [capitals / w, bare / w, doubled / w, stutter / p, repeated / p, signs / c, digits / c, upper / c, np.log1p(chars / w), long_words / w]
    return n, np.stack(rates, axis=1)


def features(text: Column) -> Column:
    """struct(n: words, x: array of FEATURES)."""

    @F.arrow_udf("struct<n:long,x:array<double>>")
    def look(texts: pa.Array) -> pa.Array:
        n, x = [np.zeros(0, np.int64)], [np.zeros((0, len(FEATURES)))]
        for s in slices(texts):
            each = _features(s)
            n.append(each[0])
            x.append(each[1])
        flat = np.concatenate(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), lists], ["n", "x"])

    return look(text)


def pairs(n_good: int, n_poor: int, partners: int = PARTNERS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the good and the poor text of each pair: every text meets ``partners`` of the other class, as evenly as may be,
    or all of them if they are fewer."""
    many, few = max(n_good, n_poor), min(n_good, n_poor)
    times = min(partners, few)
    i = np.repeat(np.arange(many), times)
    j = (i * times + np.tile(np.arange(times), many)) % few
    return (i, j) if n_good >= n_poor else (j, i)


def fit_pairs(good: np.ndarray, poor: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the strengths: Newton's method for the mean logistic loss of the pairs' differences plus the ridge."""
    both = np.concatenate([good, poor])
    sd = both.std(0)
    scale = np.where(sd > 1e-9 * (1 + np.abs(both.mean(0))), 1 / np.maximum(sd, 1e-300), 0.0)
    a, b = pairs(len(good), len(poor), partners)
    d = (good[a] - poor[b]) * scale
    w = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # how wrong each pair is
        grad = -(d * p[:, None]).mean(0) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
        size = abs(step).max()
        w -= step if size < 2 else step * (2 / size)
        if size < 1e-9:
            break
    return w * scale


@dataclass
class QualityModel:
    """Weights of FEATURES (none without both classes), the threshold strength and the share of good labels."""

    weights: list[float]
    threshold: float
    share: float
    cut: float = CUT

    def strength(self, x: Column) -> Column:
        return sum((F.lit(w) * x[j] for j, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Adds the score, from 0 to 1; the threshold scores ``cut``."""
        if not self.weights:
            return df.withColumn(out, F.lit(self.share))
        found = common.free_name(df, "quality", out)
        return self.score_features(df.withColumn(found, features(F.col(text))), found, out).drop(found)

    def score_features(self, df: DataFrame, found: str, out: str = "score") -> DataFrame:
        """As :meth:`score`, over the features in column ``found``."""
        if not self.weights:
            return df.withColumn(out, F.lit(self.share))
        z = self.strength(F.col(found)["x"]) - F.lit(self.threshold) + F.lit(math.log(self.cut / (1 - self.cut)))
        p = F.when(F.col(found)["n"] > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(self.share))
        return df.withColumn(out, p)


def train(docs: DataFrame, labels: DataFrame, pair_rows: int = PAIR_ROWS, partners: int = PARTNERS, quantile_rows: int = QUANTILE_ROWS) -> QualityModel:
    """Fit on the labelled documents outside the held-out fold; labels have (doc_id, quality)."""
    return train_features(docs.select("doc_id", features(F.col("text")).alias("f")), labels, pair_rows, partners, quantile_rows)


def train_features(docs: DataFrame, labels: DataFrame, pair_rows: int = PAIR_ROWS, partners: int = PARTNERS, quantile_rows: int = QUANTILE_ROWS) -> QualityModel:
    """As :func:`train`, over (doc_id, f: features)."""
    with common.temporary(docs.sparkSession):
        marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).where("quality in (0, 1)")
        known = docs.where("doc_id is not null").where(fold() != HELD_OUT).join(marks, "doc_id").select("doc_id", "quality", F.col("f.n").alias("n"), F.col("f.x").alias("x"))
        known = common.pin(known, "quality-features").where("n > 0")  # pinned before the filter, so that features are computed once
        n_good, n_poor = known.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
        n = n_good + n_poor
        share = (n_good + 1) / (n + 2)
        if not (n_good and n_poor):
            return QualityModel([], 0.0, share)
        sample = []
        for label in (1, 0):
            rows = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(pair_rows).select("x").toArrow()
            sample.append(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1))
        model = QualityModel([float(w) for w in fit_pairs(*sample, partners)], 0.0, share)
        # between the last of the poor share and the first beyond it
        around = [(n_poor - 0.5) / n, (n_poor + 0.5) / n]
        low, high = known.agg(F.percentile_approx(model.strength(F.col("x")), around, quantile_rows)).first()[0]
        model.threshold = (low + high) / 2
        return model


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    seen = common.pin(docs.select("doc_id", features(F.col("text")).alias("f")), "quality-all")  # each text is read once, and never shuffled
    model = train_features(seen, common.table(spark, sf_dir, "labels"))
    return model.score_features(seen, "f").select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
