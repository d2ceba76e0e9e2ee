"""Mixing weights and their realisation; packing against exhaustive search."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tidemark.llm import mixing, packing
from tidemark.llm.tokens import TOKENIZER, n_tokens

sizes = st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 10**9), min_size=1)


@settings(deadline=None)
@given(sizes, st.floats(0.5, 1.0), st.floats(1.0, 8.0))
def test_mixture(tokens, target, repeats):
    m = mixing.solve(tokens, target, repeats)
    assert math.isclose(sum(m.shares.values()), 1) and 0 <= m.exponent <= 1
    assert min(m.passes.values()) > 1 - 1e-9 and max(m.passes.values()) <= repeats * (1 + 1e-6)
    free = mixing.solve(tokens, target, 1e12)
    assert mixing.entropy(list(free.shares.values())) >= target - 1e-9
    assert m.exponent >= free.exponent - 1e-9


def documents(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 5}", 10 + i % 90) for i in range(6000)]
    return spark.createDataFrame([*rows, (None, None, None, 40), (7, "text 7", "big", 17), (7, "text 7", "big", 17)], "doc_id long, text string, source string, n long")


def test_realised_weights(spark):
    docs = documents(spark)
    plan, made = mixing.mix(docs, F.col("n"), block_tokens=20_000)
    rows = mixing.mixed_rows(docs, plan).collect()
    assert len(rows) == plan.count()
    first = Counter(r["doc_id"] for r in rows if r["epoch"] == 0)
    assert len(first) == 6001 and first[7] == 3 and sum(first.values()) == 6003  # every document once, its copies too
    tokens, blocks = Counter(), defaultdict(Counter)
    for r in rows:
        tokens[r["source"]] += r["n"]
        blocks[r["block"]][r["source"]] += r["n"]
    total = sum(tokens.values())
    for s, share in made.shares.items():
        if s is not None:
            assert abs(tokens[s] / total - share) < 0.01
            for b in blocks.values():
                assert abs(b[s] / sum(b.values()) - share) < 0.03
    assert max(Counter((r["doc_id"], r["epoch"]) for r in rows if r["doc_id"] != 7).values()) == 1
    again, _ = mixing.mix(docs, F.col("n"), block_tokens=20_000)
    key = lambda p: sorted(p.select("doc_id", "epoch", "block", "place").collect(), key=str)
    assert key(plan) == key(again)


def test_mixing_edges(spark):
    docs = documents(spark).limit(0)
    plan, _ = mixing.mix(docs, F.col("n"))
    assert plan.count() == 0 and mixing.mixed_rows(docs, plan).count() == 0
    one = spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix(one, F.lit(0))[0].count() == 1


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "same text", "a", "en", "x"), (1, "same text", "a", "de", "y"), (1, "same text", "a", "de", "y"), (2, "other", "b", "fr", "z"), (2, "other", "b", None, "z")] + [(i, f"t{i}", "a", "en", "w") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, note string").withColumn("m", F.create_map(F.lit("k"), "note"))
    plan, _ = mixing.mix(docs, F.lit(5))
    got = [tuple(r) for r in mixing.mixed_rows(docs, plan).collect()]
    key = lambda r: (r[0], str(r[3]), r[4])
    first = Counter(key(r) for r in got if r[-3] == 0)
    assert first == Counter((r[0], str(r[3]), r[4]) for r in rows)
    again = Counter(key(r) for r in got)
    assert sum(again.values()) == plan.count() and all(first[k] <= n <= 2 * first[k] for k, n in again.items())


def test_one_document_with_most_rows_is_spread(spark):
    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"), F.lit("one text").alias("text"), F.lit("s").alias("source"))
    plan, _ = mixing.mix(rows, F.lit(1), block_tokens=1000)
    blocks = Counter(r["block"] for r in plan.where("doc_id is null").collect())
    assert plan.count() == n and len(blocks) == n // 1000 and max(blocks.values()) < 2 * n // 3 / 10


def test_null_ids_are_spread_over_ranges(spark):
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(None).cast("long")).alias("doc_id"), F.lit(100).alias("n"))
    packed = packing.pack(rows, "n", ["doc_id"], buckets=1, budget=100 * 50)
    got = Counter(r["batch"] for r in packed.where("doc_id is null").collect())
    assert packed.count() == n and len(got) > 0.9 * n / 50 and max(got.values()) <= 50
    plan = packed._jdf.queryExecution().toString()
    assert "hashpartitioning" in plan


def padded(histogram, bounds):
    return sum(n * min(b for b in bounds if b >= a) for a, n in histogram)


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    rows, top = list(histogram.items()), max(histogram)
    others = [a for a in histogram if a != top]
    best = min(padded(rows, {top, *c}) for k in range(min(buckets, len(rows))) for c in itertools.combinations(others, k))
    found = packing.optimal_boundaries(rows, buckets)
    assert len(found) <= buckets and found == sorted(found) and padded(rows, found) == best
    assert packing.optimal_boundaries([]) == []


def test_batches(spark):
    rows = [(i, 5 + (i * i) % 700) for i in range(9000)] + [(9001, 0), (9002, None), (None, 30), (9003, 100_000), (5, 30), (5, 30)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "n", ["doc_id"], buckets=8, budget=4096).collect()
    assert sorted(((r["doc_id"], r["n"]) for r in got), key=str) == sorted(rows, key=str)
    batches = defaultdict(list)
    for r in got:
        assert (r["n"] or 0) <= r["bucket_tokens"]
        batches[r["bucket"], r["batch"]].append(r)
    assert len({r["bucket"] for r in got}) <= 8
    for (bucket, batch), members in batches.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["bucket_tokens"] <= 4096
        if (bucket, batch + 1) in batches:  # only a bucket's last batch is not full
            assert (len(members) + 1) * members[0]["bucket_tokens"] > 4096
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "n", ["doc_id"]).count() == 0


def test_cells(spark):
    lengths = [0, 1, 4096, 4097, 5000, 10**6, 10**9 + 1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lengths], "n long").select(packing.cell(F.col("n")).cast("long")).collect()]
    assert got[:3] == lengths[:3] and all(a <= b <= a * 1.001 + 1 for a, b in zip(lengths, got, strict=True))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def spark_hash(*values):
    """xxhash64 of columns: ("int", x), ("long", x) or text."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(4 if v[0] == "int" else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h % (1 << 64))
    return signed(h)


def counted(spark):
    """(doc_id, source, text, ids) of the small documents, by the tokenizer itself."""
    encoder = Tokenizer.from_file(TOKENIZER)
    return [(r["doc_id"], r["source"], r["text"] or "", len(encoder.encode(r["text"] or "", add_special_tokens=False).ids)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def plain_mix(docs, block_tokens=mixing.BLOCK_TOKENS):
    """The definition: permuted epochs end to end up to each source's budget, cut into blocks."""
    sizes = Counter()
    for _, source, _, n in docs:
        sizes[source] += max(n, 1)
    made = mixing.solve(dict(sizes))
    blocks, out = max(1, math.ceil(made.budget / block_tokens)), set()
    for source in sizes:
        passes = round((max(sizes.values()) / sizes[source]) ** (1 - made.exponent), 9)
        budget, at = passes * sizes[source], 0
        for epoch in range(math.ceil(passes - 1e-9)):
            rows = [(spark_hash(("int", mixing.SEED), ("int", epoch), ("long", d), ("long", spark_hash(t))), d, max(n, 1)) for d, s, t, n in docs if s == source]
            for _, d, n in sorted(rows, key=lambda r: ((r[0] % (1 << 64)) >> 11, r[0], r[1])):
                if epoch == 0 or at < budget:
                    out.add((d, epoch, min(int(at / budget * blocks), blocks - 1)))
                at += n
    return out


def test_registered_mixing_query(spark):
    docs = counted(spark)
    got = [(r["doc_id"], r["epoch"], r["block"]) for r in mixing.op7_mixing(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_mix(docs)
    plan, _ = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"), n_tokens(), block_tokens=3000)
    assert {(r["doc_id"], r["epoch"], r["block"]) for r in plan.collect()} == plain_mix(docs, 3000)


def test_many_sources_are_weighed_by_spark(spark):
    tokens = {f"s{i}": 7 + (i * i * 31) % 50_000 for i in range(900)}
    table = spark.createDataFrame(list(tokens.items()), "_source string, tokens long")
    for target, repeats in ((0.97, 2.0), (0.999, 50.0), (0.9, 1.0), (0.5, 8.0)):
        made = mixing.solve(tokens, target, repeats)
        exponent, budget = mixing.solve_table(table, target, repeats)
        assert abs(exponent - made.exponent) < 1e-9 and math.isclose(budget, made.budget, rel_tol=1e-6)
    docs = documents(spark)
    a, b = (sorted(mixing.mix(docs, F.col("n"), block_tokens=20_000, collected=c)[0].select("doc_id", "epoch", "block").collect(), key=str) for c in (0, 10_000))
    assert a == b


def test_registered_packing_query(spark):
    lengths = {d: n + 1 for d, _, _, n in counted(spark)}
    histogram = sorted(Counter(lengths.values()).items())
    # best[k][j]: least padded size of the first j lengths in at most k buckets
    upto = list(itertools.accumulate((n for _, n in histogram), initial=0))
    best = [0] + [math.inf] * len(histogram)
    for _ in range(packing.BUCKETS):
        best = [0] + [min(best[i] + (upto[j] - upto[i]) * histogram[j - 1][0] for i in range(j)) for j in range(1, len(histogram) + 1)]
    got = packing.op10_packing(spark, SMALL).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == lengths and sum(r["bucket_tokens"] for r in got) == best[-1]
    members = defaultdict(list)
    for r in got:
        members[r["bucket_tokens"]].append(r)
    bounds = sorted(members)
    for r in got:
        assert r["bucket_tokens"] == min(b for b in bounds if b >= r["n_tokens"]) == bounds[r["bucket"]]
    for bound, rows in members.items():
        rows.sort(key=lambda r: (spark_hash(("long", r["doc_id"])), r["doc_id"]))
        capacity = max(1, packing.BUDGET // bound)
        assert [(r["batch"], r["slot"]) for r in rows] == [divmod(i, capacity) for i in range(len(rows))]
