"""The stages in order, each against a plain version of what it decides."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute_force
from tests.llm.test_pii import base
from tidemark.llm import common, mixing, toxicity
from tidemark.llm.tokens import TOKENIZER, word_ids


def test_stages(spark):
    docs = common.table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "pii", "mixing", "packing"]
    made, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.pin(stage(spark, docs, SMALL), f"test-{name}")
        made[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    start = common.table(spark, SMALL, "documents")
    rejected = {r["doc_id"] for r in toxicity.train(start, common.table(spark, SMALL, "labels")).score(start).where("score >= 0.5").collect()}
    left = {r["doc_id"]: r["text"] for r in made["toxicity"]}
    assert set(left) == {r["doc_id"] for r in start.collect()} - rejected
    classes = brute_force(sorted(left.items()))
    assert sorted(r["doc_id"] for r in made["ngram_join"]) == sorted({c for c, _ in classes.values()})
    for r in made["pii"]:
        spans = base(left[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and base(r["text"]) == []
        if not spans and not re.search(r"\[(email|ip|card|phone)\]", r["text"]):
            assert r["text"] == left[r["doc_id"]]
    mixed = Counter(r["doc_id"] for r in made["mixing"])
    assert set(mixed) == {r["doc_id"] for r in made["pii"]} and max(mixed.values()) <= 2
    enc, texts = word_ids(TOKENIZER), {r["doc_id"]: r["text"] for r in made["pii"]}
    assert Counter(r["doc_id"] for r in made["packing"]) == mixed
    for r in made["packing"]:
        assert r["n_tokens"] == len(enc.encode(texts[r["doc_id"]])) // enc.dtype.itemsize + 1 <= r["bucket_tokens"]
    assert corpus_pipeline.run(spark, SMALL).count() == len(made["packing"])


def test_blocks_of_the_mix_reach_the_batches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "mix", partial(mixing.mix, block_tokens=2000))
    rows = [(i, f"text {i} " + "word " * (20 + i % 5), "en", "big" if i % 3 else "small", 0) for i in range(900)]
    docs = common.pin(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "mix-test")
    plan, _ = mixing.mix(docs, corpus_pipeline.n_tokens())
    expected = [r["doc_id"] for r in plan.orderBy("block", "place").collect()]
    assert len(expected) > 950
    mixed = common.pin(corpus_pipeline.mix_sources(spark, docs, SMALL), "mix-test")
    got = corpus_pipeline.pack_batches(spark, mixed, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(expected)
    for bucket in {r["bucket"] for r in got}:
        in_order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["batch"], r["slot"])) if r["bucket"] == bucket]
        ids = set(in_order)
        assert in_order == [i for i in expected if i in ids]
    plain = corpus_pipeline.pack_batches(spark, spark.createDataFrame(rows, docs.schema), SMALL)
    assert plain.count() == 900 and plain.columns == list(got[0].asDict())


def test_only_judged_documents_are_rejected(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "!!" if i % 9 == 1 else "grobnak talk" if i % 3 else "quiet mill") for i in range(90)], "doc_id long, text string")
    for name, labels in (("toxic only", [(i, 1) for i in range(90)]), ("both", [(i, int(i % 3 > 0)) for i in range(90)])):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}/{name}").collect()}
        assert {i for i in range(90) if i % 9 < 2} <= left
        assert len(left) == 90 if name == "toxic only" else len(left) < 90
