"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares p are raised to an exponent and normalised: q ~ p^a. At a = 1 sources keep their shares, at a = 0 all are
equal. The exponent is bisected to the largest at which the entropy of q is at least the target, and raised again as far
as the repetition limit needs: the token budget is that of one full pass over the most plentiful source, so source s is
read (p_max / p_s)^(1 - a) times. Every document is read at least once, none more often than the limit, rounded up.

To realise the weights each source's documents are permuted anew for each epoch (by a seeded hash) and laid end to end up
to the source's budget. Block b takes from each source the documents that begin in the b-th of equal parts of that budget, so
every block holds the target weights, up to a document's length, and within a block a second hash mixes the sources.

Running totals per source are made in two levels: hash ranges of the permutation are summed, ranges are accumulated over a
small table, and rows add the sum of their own range; a source with a third of all rows is spread over as many ranges as
its size asks for. Up to ``COLLECTED`` sources are weighed on the driver; where there are more, the exponent is bisected by
aggregates over the table of sources, many exponents in one pass, with the same result.

Null sources are a source of their own; null and empty texts count one token, very long ones what they have. Repeated rows
are ordinary rows, each read as often as the mixture asks for, also where they differ in other columns only; many rows of one
id and text are spread over ranges by their place. An empty table gives no rows. Other columns are left as they are, but a
column of the name of a result gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.tokens import n_tokens

TARGET_ENTROPY = 0.97
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
#: A hash range of a source holds about so many documents.
RANGE_ROWS = 4096
SEED = 17
#: More sources than this are weighed by Spark instead of the driver.
COLLECTED = 10_000


@dataclass(frozen=True)
class Mixture:
    """What the sources are mixed by: exponent, share and number of passes for each source, tokens in all."""

    exponent: float
    budget: float
    shares: dict[str | None, float] = field(default_factory=dict)
    passes: dict[str | None, float] = field(default_factory=dict)


def entropy(shares: list[float]) -> float:
    """Relative to that of equal shares; 1 for a single source."""
    if len(shares) < 2:
        return 1.0
    return -sum(q * math.log(q) for q in shares if q > 0) / math.log(len(shares))


def temper(tokens: list[float], a: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** a for t in tokens]
    return [r / math.fsum(raised) for r in raised]


def _bisect(fits, rounds: int = 60) -> float:
    """The largest exponent from 0 to 1 that fits, where smaller ones fit too."""
    if fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def solve(tokens: dict[str | None, float], target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> Mixture:
    """The exponent that meets the entropy; where that would repeat a source too often, the one that meets the limit."""
    if not tokens:
        return Mixture(1.0, 0.0)
    names, sizes = list(tokens), [float(x) for x in tokens.values()]
    a = _bisect(lambda e: entropy(temper(sizes, e)) >= target_entropy - 1e-12)
    spread = max(sizes) / min(sizes)
    least = 1 - _bisect(lambda e: spread**e <= max_repeats * (1 + 1e-12))  # spread^(1 - a) may be max_repeats
    a = max(a, least)
    shares = temper(sizes, a)
    budget = max(t / q for t, q in zip(sizes, shares, strict=True))
    passes = [q * budget / t for t, q in zip(sizes, shares, strict=True)]
    return Mixture(a, budget, dict(zip(names, shares, strict=True)), dict(zip(names, passes, strict=True)))


def solve_table(sources: DataFrame, target_entropy: float, max_repeats: float, at_once: int = 32) -> tuple[float, float]:
    """(exponent, budget) as :func:`solve` finds them, over a pinned table of sources with their ``tokens``.

    Sums are of decimals, so they do not depend on the order of rows.
    """
    n, top, least = sources.agg(F.count("*"), F.max("tokens"), F.min("tokens")).first()
    share = F.log(F.col("tokens") / float(top))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """For each: the sum of raised shares, and of these times their logarithms."""
        exact = lambda c: F.sum(c.cast("decimal(38,18)"))
        row = sources.agg(*[f(a) for a in exponents for f in (lambda a: exact(F.exp(a * share)), lambda a: exact(F.exp(a * share) * a * share))]).first()
        return [(float(row[2 * i]), float(row[2 * i + 1])) for i in range(len(exponents))]

    met = lambda s, t: n < 2 or (math.log(s) - t / s) / math.log(n) >= target_entropy - 1e-12
    low, high = 0.0, 1.0
    if met(*sums([1.0])[0]):
        low = 1.0
    while high - low > 1e-15 and low < 1.0:
        tried = [low + (high - low) * i / at_once for i in range(1, at_once)]
        fits = [met(*x) for x in sums(tried)]
        k = fits.index(False) if False in fits else len(tried)
        low, high = ([low, *tried][k], [*tried, high][k])
        if tried[0] == low or tried[-1] == high:
            break
    spread = float(top) / float(least)
    a = max(low, 1 - _bisect(lambda e: spread**e <= max_repeats * (1 + 1e-12)))
    return a, float(top) * sums([a])[0][0]  # the most plentiful source is read once


def _unit(*parts: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, tokens: Column, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, collected: int = COLLECTED) -> tuple[DataFrame, Mixture]:
    """The keys of ``docs`` as often as the mixture reads them, with ``epoch, block, place``, and the mixture.

    ``place`` orders a block. More than ``collected`` sources are weighed by Spark, and the mixture does not list them.
    """
    with common.temporary(docs.sparkSession) as scope:
        # the texts themselves do not take part: a slim table is laid out and joined back by the row's key
        slim = docs.select("doc_id", "source", F.xxhash64(common.text_or_empty("text")).alias("_hash"), F.greatest(tokens, F.lit(1)).cast("long").alias("_tokens"), common.row_hash(docs).alias("_row"))
        slim = common.pin(slim, "mix-rows").withColumn("_copy", F.monotonically_increasing_id())
        # rows of an id and text that would fill a range are told apart by their place, others go by their hash alone
        often = common.pin(slim.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_text")).count().where(F.col("count") > RANGE_ROWS), "mix-often")
        spread = F.lit(0).cast("long")
        if not often.isEmpty():
            slim = slim.join(often, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left").drop("_id", "_text")
            spread = F.when(F.col("count").isNotNull(), F.xxhash64(F.lit(seed), "epoch", "_copy"))
        sources = common.pin(slim.groupBy(F.col("source").alias("_source")).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")), "mix-sources")
        rows = sources.limit(collected + 1).collect()
        if len(rows) <= collected:
            made = solve({r["_source"]: r["tokens"] for r in sorted(rows, key=lambda r: (r["_source"] is not None, r["_source"]))}, target_entropy, max_repeats)
        else:
            made = Mixture(*solve_table(sources, target_entropy, max_repeats))
        top = sources.agg(F.max("tokens")).first()[0] or 1
        # (p_max / p_s)^(1 - a), rounded so that a whole number of passes is one
        passes = F.round(F.pow(F.lit(float(top)) / F.col("tokens"), F.lit(1 - made.exponent)), 9)
        plan = sources.select("_source", passes.alias("_passes"), (passes * F.col("tokens")).alias("_source_budget"), F.ceil(F.col("n") / RANGE_ROWS).cast("int").alias("_ranges"))
        blocks = max(1, math.ceil(made.budget / block_tokens))
        plan = F.broadcast(plan) if len(rows) <= collected else plan
        key = F.xxhash64(F.lit(seed), "epoch", "doc_id", "_hash")
        laid = (
            slim.join(plan, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_passes") - 1e-9).cast("int") - 1)))
            .withColumn("_key", key if often.isEmpty() else F.coalesce(spread, key))
            .withColumn("_unit", F.shiftrightunsigned("_key", 11).cast("double") / float(1 << 53))
            .withColumn("_range", F.floor(F.col("_unit") * F.col("_ranges")).cast("int"))
        )
        totals = laid.groupBy("_source", "epoch", "_range").agg(F.sum("_tokens").alias("_sum"))
        stream = Window.partitionBy("_source").orderBy("epoch", "_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("_source", "epoch", "_range", F.coalesce(F.sum("_sum").over(stream), F.lit(0)).alias("_before"))
        within = Window.partitionBy("_source", "epoch", "_range").orderBy("_unit", "_key", "doc_id", "_copy").rowsBetween(Window.unboundedPreceding, -1)
        on = F.col("s._source").eqNullSafe(F.col("r._source")) & (F.col("s.epoch") == F.col("r.epoch")) & (F.col("s._range") == F.col("r._range"))
        laid = laid.withColumn("_in_range", F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
        laid = laid.alias("r").join(starts.alias("s"), on).select("r.*", (F.col("_before") + F.col("_in_range")).alias("_start"))
        chosen = laid.where((F.col("epoch") == 0) | (F.col("_start") < F.col("_source_budget"))).select(
            "doc_id", "_hash", F.col("source").alias("_source"), "epoch",
            F.least(F.floor(F.col("_start") / F.col("_source_budget") * blocks), F.lit(blocks - 1)).cast("long").alias("block"),
            _unit(F.lit(seed + 1), F.col("_key")).alias("place"), "_copy", "_row",
        )
        return scope.keep(common.pin(chosen, "mix-plan")), made


def mixed_rows(docs: DataFrame, plan: DataFrame, epoch: str = "epoch", block: str = "block", place: str = "place") -> DataFrame:
    """The documents themselves, once for each row of the plan, with ``epoch, block, place`` under the names given.

    ``docs`` are the rows that the plan was made of, with the same columns. Rows that are alike in all of them are interchangeable.
    """
    results = [epoch, block, place]
    columns = [c for c in docs.columns if c.lower() not in {r.lower() for r in results}]
    k1, k2, text, row = (common.free_name(docs, x, *results) for x in ("mix1", "mix2", "mixtext", "mixrow"))
    keys = [k1, k2, row]
    key = lambda source, text: {k1: F.xxhash64("doc_id", source, text), k2: F.xxhash64(text, source, F.lit(1), "doc_id")}
    keyed = docs.withColumns({text: F.xxhash64(common.text_or_empty("text")), row: common.row_hash(docs)}).withColumns(key("source", text)).select(*columns, *keys)
    planned = plan.withColumns(key("_source", "_hash")).select(k1, k2, F.col("_row").alias(row), F.col("epoch").alias(epoch), F.col("block").alias(block), F.col("place").alias(place))
    if not plan.where("epoch = 0").groupBy("doc_id", "_source", "_hash", "_row").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(keys)
    return keyed.join(planned, keys).select(*columns, *results)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    plan, _ = mix(docs, n_tokens())
    return plan.select("doc_id", F.col("_source").alias("source"), "epoch", "block", "place")
