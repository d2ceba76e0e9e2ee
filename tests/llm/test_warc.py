"""Round trips, which record is the response, and chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import warc


def expected(rows, min_bytes=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    size = lambda h: len((h or "").encode())
    best = {}
    for page, html in rows:
        if page is not None:
            best[digest(html)] = max(best.get(digest(html), page), page)
    out = []
    for page, html in rows:
        top = best.get(digest(html)) if size(html) >= min_bytes else None
        revisit = top is not None and top != page
        out.append((page, size(html), digest(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert got(warc.op9_warc(spark, SMALL)) == expected([(r["page_id"], r["html"]) for r in pages.collect()])


def test_edges(spark, folder):
    rows = [(1, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (2, "same"), (5, "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "x" * 3_000_000), (7, "x" * 3_000_000), (None, "only")]
    pages = spark.createDataFrame([(p, f"http://a/ {i}", h, "z") for i, (p, h) in enumerate(rows)], "page_id long, url string, html string, sha1 string")
    manifest = warc.archive_pages(pages, folder, chunk_bytes=1 << 20)
    chunks = warc.read_warc(manifest, chunk_bytes=1 << 20)
    last = chunks.where("last").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), "declared_digest", "record_type", "refers_to"
    )
    assert got(last) == expected(rows)
    big = chunks.where("page_id = 7").orderBy("chunk_no").collect()
    assert [len(r["data"]) for r in big] == [1 << 20, 1 << 20, 3_000_000 - (2 << 20)]
    assert big[-1]["sha1_so_far"] == hashlib.sha1(b"x" * 3_000_000).digest()
    assert chunks.select("record_id").distinct().count() == len(rows)
    for r in manifest.collect():
        with gzip.open(r["path"].removeprefix("file://")) as f:
            assert f.read().count(b"WARC-Record-ID") == r["n_records"] + 1  # and the warcinfo record
    assert warc.read_warc(warc.archive_pages(pages.limit(0), folder + "/none")).count() == 0


def test_threshold(spark):
    rows = spark.createDataFrame([(1, b"ab"), (2, b"ab"), (1, b"abcd"), (2, b"abcd")], "page_id long, payload binary")
    decided = warc.decide(warc.payload_digests(rows, ["page_id"]), min_bytes=3)
    assert sorted((r["payload_bytes"], r["page_id"], r["refers_to"]) for r in decided.collect()) == [(2, 1, None), (2, 2, None), (4, 1, 2), (4, 2, None)]


def test_references_and_urls(spark, folder):
    urls = ["http://a/x y\u2028z\r\n%20", None, "", "urn:none", "http://b/é"]
    rows = [(i, u, "same" if i < 3 else f"p{i}") for i, u in enumerate(urls)]
    manifest = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    read = {r["page_id"]: r for r in warc.read_warc(manifest).collect()}
    assert {i: r["url"] for i, r in read.items()} == dict(enumerate(urls))
    heads = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in manifest.collect()).decode()
    assert heads.count(f"WARC-Refers-To: {read[2]['record_id']}") == 2 and heads.count("WARC-Type: warcinfo") == manifest.count()


def test_one_digest_on_a_third_of_the_rows(spark, folder):
    """The hot digest meets its response in a join that can be split: no task gets all its rows."""
    pages = spark.range(90_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    keep = {
        "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        decided = warc.decide(warc.payload_digests(pages.select("page_id", F.col("html").alias("payload")).repartition(8), ["page_id"]))
        assert decided.where("refers_to is not null").count() == 29_999
        decided.withColumn("p", F.spark_partition_id()).write.parquet(f"{folder}/placed")
        sizes = [r["count"] for r in spark.read.parquet(f"{folder}/placed").groupBy("p").count().collect()]
        assert sum(sizes) == 90_000 and max(sizes) < 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_revisits_are_not_shuffled(spark, folder, monkeypatch):
    """Beyond the bound of the broadcast the archives are the same."""
    rows = [(i, None, "same " * 50 if i % 3 else f"own {i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    write = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda chunks, *rest: seen.append(chunks.count()) or write(chunks, *rest))
    read = lambda m: sorted(tuple(r) for r in warc.read_warc(m).where("last").select("page_id", "record_type", "declared_digest", "digest").collect())
    few = read(warc.archive_pages(pages, f"{folder}/a"))
    monkeypatch.setattr(warc, "REVISIT_KEYS", 3)
    assert read(warc.archive_pages(pages, f"{folder}/b")) == few and len(few) == 30
    assert seen == [11, 30]


def test_a_payload_that_changed_is_refused(spark, folder):
    """The writer holds the digest that the chunks carry against the head's."""
    records = spark.createDataFrame([("k", b"before"), ("l", b"")], "record_key string, payload binary")
    heads = warc.payload_digests(records, ["record_key"]).selectExpr("record_key", "1L page_id", "'u' url", "payload_bytes", "sha1", "cast(null as long) refers_to", "cast(null as string) response_key")
    assert warc.write_warc(warc.chunk_records(records, chunk_bytes=2), heads, f"{folder}/a").agg(F.sum("n_records")).first()[0] == 2
    changed = records.withColumn("payload", F.when(F.col("record_key") == "k", F.lit(b"after!")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="not the one its digest was taken of"):
        warc.write_warc(warc.chunk_records(changed), heads, f"{folder}/b")
    with pytest.raises(Exception, match="not the one its digest was taken of"):
        warc.write_warc(warc.chunk_records(records.limit(0)), heads, f"{folder}/c")
