"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, of toxic and of ordinary text, predict each letter of a word from the ORDER - 1 before it. Both are absolute
discounted estimates (a discount for counts of one, two and more, from the counts of counts of their class) that back off
to *one* shared model, an interpolated Kneser-Ney model over the pooled n-grams whose lower orders rest on shared
continuation counts. An expression that a class has hardly seen is thus as likely in both, and only what a class has
seen often moves a score; inflected and compound forms share the letters of their stem.

Counts cover every labelled row outside the held-out fold and are made with DataFrame aggregates and joins. The result is the
log-likelihood ratio of each n-gram and, for unseen ones, of each context. Up to ``TABLE_ROWS`` n-grams it is broadcast, as
tables of 64-bit fingerprints with an entry for each (12 bytes): no n-gram takes the ratio of another, and one that was
never seen backs off. Beyond that many the ratios stay a table: the distinct words of the texts are scored by joining
their n-grams with it, and the texts by joining their words (:meth:`ToxicityModel.joined`). Both ways give the same scores.

A text's score is a logistic function of its log-likelihood ratio per word, of the part of it above EXCESS and of its
length, fitted on the ratios of a fold under counts that have not seen it, at most ``CALIBRATION_ROWS`` rows of it. Then that
fold is counted as well, and texts are scored with the counts of all. A class that this fold lacks, or that no other has, is
calibrated on another fold of its own; one with rows in a single fold is calibrated on what was counted.

A null or empty text has no words; its score is the smoothed share of toxic labels, as is every score without labels of
both classes. Very long texts are split in slices and cost linear time. Repeated rows are scored alike, each; a document
labelled twice counts as toxic if either label does. Empty tables give no rows. Only ``doc_id``, ``text`` and the labels'
``doc_id`` and ``toxic`` are read; a column with the name of a result is replaced by it, all others stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.words import Slice, chained, held, slices

ORDER = 6
#: The logistic fit uses the rows of its fold with the least hashes, this many at most.
CALIBRATION_ROWS = 20_000
FOLDS = 5
HELD_OUT, CALIBRATION = 0, 4
#: A word with a log-likelihood ratio above this counts as an expression of its own.
EXCESS = 2.5
START, END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+|\d+")
#: N-grams whose ratios are broadcast, at most (12 bytes each, and as much again for their contexts).
TABLE_ROWS = 1 << 23


def fold(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def words_of(text: str) -> list[str]:
    if text.isascii() and text.isalpha():
        return [text.lower()]
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]


def word_counts(labelled: DataFrame) -> DataFrame:
    """calibration, toxic, word, n over rows of (calibration, toxic, text); batches are counted before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = 2 * batch.column(0).to_numpy(zero_copy_only=False) + batch.column(1).to_numpy()
            counters = [Counter() for _ in range(4)]
            for s in slices(batch.column(2)):
                group = np.repeat(groups[s.first : s.first + len(s.texts)], np.diff(s.starts))
                for g in np.unique(group):
                    seen = np.bincount(s.codes[group == g], minlength=len(s.words))
                    for i in np.flatnonzero(seen).tolist():
                        for w in words_of(s.words[i]):
                            counters[g][w] += int(seen[i])
            for g, seen in enumerate(counters):
                m = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array([g > 1] * m, pa.bool_()), pa.array([g % 2] * m, pa.int32()), pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["calibration", "toxic", "word", "n"])

    counted = labelled.select("calibration", "toxic", "text").mapInArrow(count, "calibration boolean, toxic int, word string, n long")
    return counted.groupBy("calibration", "toxic", "word").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame, order: int) -> DataFrame:
    """gram, t, o: how often each n-gram of letters occurs in toxic and in ordinary words."""
    padded = F.concat(F.lit(START * (order - 1)), "word", F.lit(END))
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring("_p", i, F.lit(order))))
    rows = words.withColumn("_p", padded).select("toxic", "n", grams.alias("gram"))
    return rows.groupBy("gram").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))


def _discounts(*counts: tuple[DataFrame, str]) -> list[list[float]]:
    """For each (table, column) the discounts of counts 1, 2 and from 3 on, by the counts of counts (as Chen and Goodman have them)."""
    tables = [t.agg(F.lit(k).alias("k"), *[F.count_if(F.col(c) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]) for k, (t, c) in enumerate(counts)]
    found = []
    for row in sorted(reduce(DataFrame.unionByName, tables).collect()):
        n1, n2, n3, n4 = (max(1, x) for x in row[1:])
        y = n1 / (n1 + 2 * n2)
        found.append([min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
    return found


def _discounted(c: str, d: list[float]) -> Column:
    x = F.col(c)
    return F.when(x == 0, 0.0).when(x == 1, x - d[0]).when(x == 2, x - d[1]).otherwise(x - d[2])


def _taken(c: str, d: list[float]) -> Column:
    """What the discounts of a context add up to."""
    x = F.col(c)
    return F.sum(F.when(x == 0, 0.0).when(x == 1, d[0]).when(x == 2, d[1]).otherwise(d[2]))


def _with_context(grams: DataFrame, *aggregates: Column) -> DataFrame:
    grams = grams.withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    return grams.join(grams.groupBy("context").agg(*aggregates), "context")


def _shared(grams: DataFrame, order: int) -> DataFrame:
    """gram, p: the interpolated Kneser-Ney probability of each pooled n-gram's last letter."""
    levels = [grams.select("gram", (F.col("t") + F.col("o")).alias("c"))]
    for _ in range(order - 1):  # continuation counts: how many different letters stand before
        levels.append(common.pin(levels[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), "kneser-ney-counts"))
    levels.reverse()
    total = levels[0].agg(F.sum("c")).first()[0] or 1
    p = levels[0].select("gram", (F.col("c") / total).alias("p"))
    for level, d in zip(levels[1:], _discounts(*[(level, "c") for level in levels[1:]]), strict=True):
        known = _with_context(level, F.sum("c").alias("all"), _taken("c", d).alias("taken"))
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        p = known.join(lower, F.expr("substring(gram, 2)") == F.col("suffix")).select("gram", ((_discounted("c", d) + F.col("taken") * F.col("lower")) / F.col("all")).alias("p"))
        p = common.pin(p, "kneser-ney")
    return p


def log_ratios(words: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(gram, n, ratio) of the n-grams seen in either class, and (context, n, ratio) for those not seen after it."""
    grams = common.pin(_grams(words, order), "toxic-grams")
    dt, do = _discounts((grams, "t"), (grams, "o"))
    rows = _with_context(grams, F.sum("t").alias("all_t"), F.sum("o").alias("all_o"), _taken("t", dt).alias("taken_t"), _taken("o", do).alias("taken_o")).join(_shared(grams, order), "gram")
    share = lambda c, d: F.when(F.col(f"all_{c}") > 0, (_discounted(c, d) + F.col(f"taken_{c}") * F.col("p")) / F.col(f"all_{c}")).otherwise(F.col("p"))
    left = lambda c: F.when(F.col(f"all_{c}") > 0, F.col(f"taken_{c}") / F.col(f"all_{c}")).otherwise(1.0)
    rows = common.pin(rows.select("gram", "context", (F.col("t") + F.col("o")).alias("n"), F.log(share("t", dt) / share("o", do)).alias("ratio"), F.log(left("t") / left("o")).alias("unseen")), "toxic-ratios")
    return rows.select("gram", "n", "ratio"), rows.groupBy("context").agg(F.sum("n").alias("n"), F.first("unseen").alias("ratio"))


def _keys(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams that begin at each code point, and of their contexts (all but the last)."""
    m = len(points) - order + 1
    x, context = np.zeros(m, np.uint64), None
    for j in range(order):
        context, x = x, chained(x, points[j : j + m])
    return x, context


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _table(ratios: DataFrame, key: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of all keys, of so many letters each, ascending, and their ratios."""
    rows = ratios.select(key, F.col("ratio").cast("float").alias("ratio")).toArrow()
    parts = [_keys(_points("".join(b.column(0).to_pylist())), order)[0][::order] for b in rows.to_batches(max_chunksize=1 << 18) if b.num_rows]
    keys = np.concatenate([np.zeros(0, np.uint64), *parts])
    at = np.argsort(keys)
    return keys[at], rows.column("ratio").to_numpy()[at]


class WordRatios:
    """The log-likelihood ratio of words, toxic against ordinary."""

    def __init__(self, seen: tuple[np.ndarray, np.ndarray], unseen: tuple[np.ndarray, np.ndarray], order: int):
        self.seen, self.unseen, self.order = seen, unseen, order

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(table[0]):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], missing).astype(float)

    def of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        n = np.array([len(w) for w in words], np.int64) + 1  # n-grams of each word
        pad = START * (self.order - 1)
        grams, contexts = _keys(_points("".join([f"{pad}{w}{END}" for w in words])), self.order)
        first = np.cumsum(n) - n
        at = np.repeat(np.arange(len(words)) * (self.order - 1), n) + np.arange(int(n.sum()))  # each word brings its padding
        ratio = self._get(self.seen, grams[at], np.nan)
        new = np.flatnonzero(np.isnan(ratio))
        # where neither class has seen the context, both back off alike
        ratio[new] = self._get(self.unseen, contexts[at[new]], 0.0)
        return np.add.reduceat(ratio, first)

    def of_slice(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its ratio per word, what words have above EXCESS, and the count of words."""
        found = [words_of(w) for w in s.words]
        distinct = list(dict.fromkeys(w for ws in found for w in ws))
        place, ratio = {w: i for i, w in enumerate(distinct)}, self.of(distinct)
        size = np.array([len(ws) for ws in found], np.int64)
        owner, ratio = np.repeat(np.arange(len(found)), size), ratio[[place[w] for ws in found for w in ws]] if distinct else ratio
        each = [np.bincount(owner, x, len(found)) for x in (ratio, np.maximum(ratio - EXCESS, 0))]
        n = s.sums(size.astype(float))
        return s.sums(each[0]) / np.maximum(n, 1), s.sums(each[1]), n.astype(np.int64)


RATIOS = "struct<ratio:double,excess:double,n:long>"


@dataclass
class ToxicityModel:
    """Ratios, weights and the share of toxic labels. Ratios are either ``tables``, a broadcast pair, or ``rows``, a pair of DataFrames;
    without a model both are None."""

    tables: object
    weights: list[float]
    share: float
    order: int = ORDER
    rows: tuple[DataFrame, DataFrame] | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ratios(self, text: Column) -> Column:
        """struct(ratio: log-likelihood ratio per word, excess: sum of what words have above EXCESS, n: words)."""
        tables, order, key = self.tables, self.order, self.key

        @F.arrow_udf(RATIOS)
        def score(texts: pa.Array) -> pa.Array:
            model = held(("toxicity", key), lambda: WordRatios(*tables.value, order))
            parts = [model.of_slice(s) for s in slices(texts)]
            found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
            return pa.StructArray.from_arrays([pa.array(x) for x in found], ["ratio", "excess", "n"])

        return score(text)

    def joined(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """As :meth:`ratios`, by joins: texts to their distinct words, these to their n-grams."""
        row = common.free_name(df, "row")
        keyed = common.pin(df.withColumn(row, F.monotonically_increasing_id()), "toxic-rows")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in slices(batch.column(1)):
                    ids = np.repeat(batch.column(0).slice(s.first, len(s.texts)).to_numpy(), np.diff(s.starts))
                    counts = Counter(zip(ids.tolist(), s.codes.tolist(), strict=True))
                    parts = [words_of(w) for w in s.words]
                    rows = [(i, w, n) for (i, c), n in counts.items() for w in parts[c]]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["row", "word", "n"])

        words = common.pin(keyed.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(split, "row long, word string, n long"), "toxic-row-words")
        distinct = words.select("word").distinct()
        seen, unseen = self.rows
        padded = F.concat(F.lit(START * (self.order - 1)), "word", F.lit(END))
        grams = distinct.withColumn("_p", padded).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring("_p", i, F.lit(self.order)))).alias("gram"))
        known = grams.join(seen.select("gram", F.col("ratio").cast("float").alias("known")), "gram", "left")
        backed = known.withColumn("context", F.expr("left(gram, length(gram) - 1)")).join(unseen.select("context", F.col("ratio").cast("float").alias("backed")), "context", "left")
        ratio = common.pin(backed.groupBy("word").agg(F.sum(F.coalesce("known", "backed", F.lit(0.0)).cast("double")).alias("ratio")), "toxic-word-ratios")
        over = F.greatest(F.col("ratio") - EXCESS, F.lit(0.0))
        by_row = words.join(ratio, "word").groupBy(F.col("row").alias(row)).agg(F.sum(F.col("ratio") * F.col("n")).alias("r"), F.sum(over * F.col("n")).alias("e"), F.sum("n").alias("n"))
        found = by_row.select(row, F.struct((F.col("r") / F.col("n")).alias("ratio"), F.col("e").alias("excess"), F.col("n").alias("n")).alias(out))
        none = F.struct(F.lit(0.0).alias("ratio"), F.lit(0.0).alias("excess"), F.lit(0).cast("long").alias("n"))
        return keyed.join(found, row, "left").withColumn(out, F.coalesce(out, none)).drop(row)

    def with_ratios(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.ratios(F.col(text))) if self.rows is None else self.joined(df, text, out)

    def score(self, df: DataFrame, text: str = "text", out: str = "score", judged: str | None = None) -> DataFrame:
        """Adds the probability that a text is toxic and, if named, whether it rests on the text's words."""
        if self.tables is None and self.rows is None:
            return df.withColumns({out: F.lit(self.share)} | ({judged: F.lit(False)} if judged else {}))
        found = common.free_name(df, "toxicity", out, judged or "")
        seen = features(*(F.col(found)[c] for c in ("ratio", "excess", "n")), F.sqrt, F.log1p)
        z = self.weights[0] + sum(F.lit(w) * f for w, f in zip(self.weights[1:], seen, strict=True))
        p = F.when(F.col(found)["n"] > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(self.share))
        added = {out: p} | ({judged: F.col(found)["n"] > 0} if judged else {})
        return self.with_ratios(df, text, found).withColumns(added).drop(found)


def features(ratio, excess, n, sqrt, log1p) -> list:
    """What the logistic function sees, of Columns or of arrays: the ratio per word, as it is and against its spread
    over a text of n words, and the part of it that stems from single expressions, in sum and per word."""
    return [ratio, ratio * sqrt(n), log1p(excess), log1p(100 * excess / (n + 1)), log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on standardised columns; the first is constant, others that are get no weight."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0, 1
    still = sd <= 1e-9 * (1 + np.abs(mean))
    still[0] = False
    z, w = np.where(still, 0.0, (x - mean) / np.where(still, 1.0, sd)), np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    w = np.where(still, 0.0, w / np.where(still, 1.0, sd))
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def calibration_folds(counts: dict[int, dict[int, int]]) -> dict[int, tuple[int, bool]]:
    """For each class, of its rows in each fold: the fold to calibrate on, and whether it is counted all the same."""
    found = {}
    for label, folds in counts.items():
        if CALIBRATION in folds and len(folds) > 1:
            found[label] = (CALIBRATION, False)
        else:
            found[label] = (min(folds, key=lambda f: (folds[f], f)), len(folds) == 1)
    return found


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, slots: int | None = None, calibration_rows: int = CALIBRATION_ROWS, table_rows: int = TABLE_ROWS) -> ToxicityModel:
    """Fit on the labelled documents outside the held-out fold; labels have (doc_id, toxic).

    ``slots`` has no effect: there is an entry for each n-gram. At most ``table_rows`` of them are broadcast.
    """
    spark = docs.sparkSession
    with common.temporary(spark) as scope:
        marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        known = docs.select("doc_id", "text").where("doc_id is not null").withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
        known = common.pin(known.join(marks.where("toxic in (0, 1)"), "doc_id").select("doc_id", "fold", "toxic", "text"), "toxic-labelled")
        counts: dict[int, dict[int, int]] = {}
        for r in known.groupBy("toxic", "fold").count().collect():  # a row for each class and fold
            counts.setdefault(r["toxic"], {})[r["fold"]] = r["count"]
        n = [sum(counts.get(label, {}).values()) for label in (1, 0)]
        share = (n[0] + 1) / (n[0] + n[1] + 2) if n[0] + n[1] else 0.0
        if not all(n):
            return ToxicityModel(None, [], share)
        chosen = calibration_folds(counts)
        in_fold = reduce(or_, [(F.col("toxic") == label) & (F.col("fold") == f) for label, (f, _) in chosen.items()])
        unseen = reduce(or_, [(F.col("toxic") == label) & (F.col("fold") == f) for label, (f, seen) in chosen.items() if not seen] or [F.lit(False)])
        words = common.pin(word_counts(known.withColumn("calibration", unseen)), "toxic-words")

        def counted(words: DataFrame, weights: list[float]) -> ToxicityModel:
            seen, unseen = log_ratios(words, order)
            if seen.limit(table_rows + 1).count() > table_rows:
                return ToxicityModel(None, weights, share, order, (seen, common.pin(unseen, "toxic-contexts")))
            return ToxicityModel(spark.sparkContext.broadcast((_table(seen, "gram", order), _table(unseen, "context", order - 1))), weights, share, order)

        model = counted(words.where(~F.col("calibration")).drop("calibration"), [])
        sample = known.where(in_fold)
        if sum(counts[label][f] for label, (f, _) in chosen.items()) > calibration_rows:  # only hashes are sorted, the texts stay where they are
            last = sample.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(calibration_rows).agg(F.max("h")).first()[0]
            sample = sample.where(F.xxhash64("doc_id") <= last)
        rows = model.with_ratios(sample.select("toxic", "text"), "text", "r").select("toxic", "r.*").toArrow()
        ratio, excess, n_words, y = (rows.column(c).to_numpy().astype(float) for c in ("ratio", "excess", "n", "toxic"))
        x = np.stack([np.ones(len(y)), *features(ratio, excess, n_words, np.sqrt, np.log1p)], axis=1)
        weights = [float(w) for w in _logistic(x, y)]
        if model.tables is not None:
            model.tables.unpersist()
        final = counted(words.groupBy("toxic", "word").agg(F.sum("n").alias("n")), weights)
        if final.rows is not None:
            scope.keep_all()
        return final


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return model.score(docs.select("doc_id", "text")).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
