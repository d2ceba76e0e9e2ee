"""Every operator and stage over columns named like its helpers, and over nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_toxicity import corpus
from tidemark.llm import ann, common, mixing, ngram_join, order_minhash, packing, pii, secrets, tokens, toxicity, warc

HELPERS = (
    "_score _judged _row _toxicity ratio toxic fold score judged word n gram _id _text_hash _row_hash _hash _key set_id bands kept label node copies "
    "_spans _masked _pii _piitext _redact candidates epoch block place _epoch _block _place _tokens _source _passes _k1 _mix1 _mix2 _mixtext _mixrow "
    "bucket bucket_tokens batch slot _cell _bucket _range _copy _nth _before _part _file _visitor _next _tie _at _top sketch edited part c q asks "
    "query_id rank _h1 _h2 _last parts row scope start end kind role keep spans record_key payload sha1 payload_bytes refers_to response_key chunk_no"
).split()
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    made = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in corpus(120)]
    made += [(None, "no id at all here", "de", None, 5), (500, None, None, "s0", None), (501, "", "en", "s1", 0), (502, "?!", "en", "s1", 2), (503, "word " * 60_000 + "a@b.cc", "en", "s2", 1)]
    made += [(504, "the same text twice with some more words in it", "en", "s0", 9)] * 2 + [(504, "the same id again but another text with words", "en", "s0", 9), (505, None, "fr", "s0", 0)]
    return made


@pytest.fixture(scope="module")
def folder_of_labels(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("edges")
    labels = [(i, toxic, 1) for i, _, toxic in corpus(120)] + [(None, 1, 1), (7, 1, 0), (7, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def clashing(df):
    """With a column for each helper name, which holds that name."""
    return df.withColumns({h: F.lit(h) for h in HELPERS if h not in df.columns})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folder_of_labels, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = common.pin(spark.createDataFrame(rows(), DDL), "edges")
    named = common.pin(clashing(plain), "edges")
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "lang", "source"))
    a, b = (sorted((key(r) + ((r["text"],) if "text" in r else (r["n_tokens"], r["bucket_tokens"])) for r in stage(spark, df, folder_of_labels).collect()), key=str) for df in (plain, named))
    assert a == b
    out = stage(spark, named, folder_of_labels)
    if name != "packing":
        assert out.columns == named.columns
        for r in out.collect():
            assert all(r[h] == h for h in HELPERS)
    ids = [k[0] for k in a]
    assert name == "toxicity" or ids.count("503") >= 1
    if name == "toxicity":
        assert {"500", "501", "502", "505"} <= set(ids) and [k[3] for k in a].count(rows()[-4][1]) in (0, 2)
    if name == "ngram_join":
        assert ids.count("504") == 2 and [i for i in ("500", "501", "505") if i in ids] == ["500"]
    if name in ("pii", "packing"):
        assert len(a) == len(rows())
    if name == "pii":
        assert dict((k[0], k[3]) for k in a)["503"].endswith("word [email]") and dict((k[0], k[3]) for k in a)["500"] is None
    if name == "mixing":
        assert set(ids) == {str(r[0]) for r in rows()} and ids.count("504") >= 3
    assert stage(spark, named.limit(0), folder_of_labels).count() == 0


def test_operators(spark, folder_of_labels, folder):
    docs = clashing(spark.createDataFrame(rows(), DDL))
    docs = common.pin(docs, "edges")
    n = len(rows())
    labels = spark.read.parquet(f"{folder_of_labels}/labels.parquet")
    scored = toxicity.train(docs, clashing(labels)).score(docs.drop("score"))
    assert scored.count() == n and scored.drop("score").columns == docs.drop("score").columns
    assert order_minhash.fingerprint_edits(docs).count() == n
    assert ngram_join.join_ngrams(docs).count() == n
    read = tokens.read_token_files(tokens.write_token_files(docs, f"{folder}/tokens"))
    assert read.count() == n and read.agg(F.countDistinct("start")).first()[0] == n
    found = pii.find_pii(docs)
    assert found.count() == n and set(docs.columns) < set(found.columns)
    plan, _ = mixing.mix(docs, tokens.n_tokens())
    mixed = mixing.mixed_rows(docs, plan)
    assert mixed.count() == plan.count() >= n and sorted(mixed.columns) == sorted(docs.columns)
    assert mixed.where("epoch is null or _epoch <> '_epoch'").count() == 0
    assert sorted(r["doc_id"] or 0 for r in secrets.scan_secrets(docs).collect()) == sorted(r[0] or 0 for r in rows())
    packed = packing.pack(docs.withColumn("size", F.length("text")), "size", ["doc_id"])
    assert packed.count() == n and sorted(packed.columns) == sorted([*docs.columns, "size"])
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *HELPERS)
    assert warc.read_warc(warc.archive_pages(pages, f"{folder}/warc")).where("last").count() == n
    vectors = docs.where("doc_id is not null").select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double"), F.lit(None).cast("double") if n < 0 else F.lit(2.0)).alias("embedding"), *HELPERS)
    assert ann.search(vectors, F.col("vec_id") % 20 == 0).select("query_id").distinct().count() == 6 + 1


def test_order_of_repeated_ids(spark, folder):
    some = [(7, f"text {i}") for i in range(50)] + [(None, f"other {i}") for i in range(50)] + [(i, "x") for i in range(8, 30)]
    starts = []
    for k, n in enumerate((3, 8)):
        docs = spark.createDataFrame(some[:: -1 if k else 1], "doc_id long, text string").repartition(n)
        got = tokens.read_token_files(tokens.write_token_files(docs, f"{folder}/t{k}")).orderBy("start").collect()
        starts.append([(r["doc_id"], r["start"], r["ids_crc32"]) for r in got])
    assert starts[0] == starts[1] and [d for d, _, _ in starts[0]] == [None] * 50 + [7] * 50 + list(range(8, 30))
