"""Base spans against plain patterns, loose spans, redaction and runs that are hard on patterns."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import MEDIUM, SMALL
from tidemark.llm import common, pii


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0


n_digits = lambda s: sum(c.isdigit() for c in s)
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= n_digits(s) <= 19 and luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= n_digits(s) <= 15),
}


def base(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, ok) in PLAIN.items() for m in re.finditer(pattern, text) if ok(m[0])]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    rows = pii.redact(pii.find_pii(docs), out="masked").orderBy("doc_id").collect()
    return [([(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in r["pii"]], [(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in r["pii"] if s["base"]], r["masked"]) for r in rows]


def test_documents(spark):
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, MEDIUM).collect()}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        spans = base(r["text"])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(text.split(",")) <= set(got[r["doc_id"]]["spans"].split(","))


def test_loose_spans(spark):
    texts = [
        "write to anna [at] mail [dot] com today", "phone (555) 123-4567 please", "fe80:0:0:0:202:b3ff:fe1e:8329 is the host address",
        "release 1234 5678 9012 3456 7", "we met at home. Then it rained", "call +1 (555) 123-4567 now", None, "",
    ]
    kinds = [[s[0] for s in spans] for spans, _, _ in found(spark, texts)]
    assert kinds == [["email"], ["phone"], ["ip"], [], [], ["phone"], [], []]


def test_redaction(spark):
    got = [m for _, _, m in found(spark, ["é a.b@c.de, 1.2.3.4 and +49 30 1234567!", "nothing", "x@y.zz"])]
    assert got == ["é [email], [ip] and [phone]!", "nothing", "[email]"]


def test_long_runs(spark):
    texts = ["1" * 8_000, "a" * 8_000 + "@", "a@" + "b." * 30_000 + "c", "1." * 20_000, "1 " * 20_000, "+1" + "(" * 50_000, "+1 555 123 4567, " * 500, "a-" * 4_000, "x@y." * 1_000 + "é"]
    got = found(spark, texts)
    for text, (_, strict, _) in zip(texts, got, strict=True):
        assert strict == base(text)
    assert [s for s, _, _ in found(spark, ["a@b.cc"] * 2 + ["plain"])] == [[("email", 0, 6)]] * 2 + [[]]


ALPHABET = st.text(alphabet="ab1234567890@.-+() _%,é:", max_size=50)


@settings(deadline=None, max_examples=1, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(ALPHABET, min_size=200, max_size=400))
def test_any_text(spark, texts):
    for text, (_, strict, _) in zip(texts, found(spark, texts), strict=True):
        assert strict == base(text), text


def test_many_spans_in_one_text(spark):
    texts = ["é a.b@c.de or 0" + "555 123 4567, " * n + "1.2.3.4 end" for n in (8_000, 64_000)]
    took = []
    for text in texts:
        began = time.perf_counter()
        [(spans, strict, masked)] = found(spark, [text])
        took.append(time.perf_counter() - began)
        assert strict == base(text) and len(spans) > 2
        plain, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            plain += [text[at:a], f"[{kind}]"]
            at = b
        assert masked == "".join(plain) + text[at:]
    assert took[1] < max(30, 12 * took[0])  # eight times the spans


def test_overlapping_spans_are_masked_whole(spark):
    spans = [(0, 2, 6), (3, 2, 4), (1, 5, 9), (2, 9, 11), (0, 20, 21)]
    rows = [("".join(chr(97 + i) for i in range(24)) * (1 + 100 * k), [(r, a + 24 * 90 * k, b + 24 * 90 * k) for r, a, b in spans], "kept") for k in (0, 1)]
    df = spark.createDataFrame(rows, "text string, pii array<struct<rank:int,start:int,end:int>>, _redact string")
    for (text, s, _), r in zip(rows, pii.redact(df).collect(), strict=True):
        a = s[0][1] - 2
        assert r["redacted"] == text[: a + 2] + "[email][card]" + text[a + 11 : a + 20] + "[email]" + text[a + 21 :] and r["_redact"] == "kept"


def test_labelers_propose_planted_spans(spark):
    """Planted loose spans of every kind among decoys: what is found, and what is left alone."""
    good, decoys = [], []
    for i in range(60):
        good += [
            (f"please mail anna{i} [at] example [dot] org for it", "email"), (f"write to user{i} @ gmail today", "email"),
            (f"phone: (0{30 + i}) 555-12{10 + i}", "phone"), (f"tel. 0049 {30 + i} 1234567 works", "phone"),
            (f"ip: 2001:db8:0:{i}::{i + 1} is the server", "ip"),
        ]
        decoys += [f"release 20{10 + i}.11.12 of version 3.{i}", f"we met at noon dot and we talked {i}", f"order 1234{i:02} 5678 9012 3{i:03} 1 shipped", f"section {i}::{i + 1} of the code", f"page 10{i} - 20{i} - 30{i}"]
    texts = [t for t, _ in good] + decoys
    got = found(spark, texts)
    hits = sum(any(s[0] == kind for s in spans) for (spans, _, _), (_, kind) in zip(got, good))
    false = sum(bool(spans) for spans, _, _ in got[len(good) :])
    print("recall", hits / len(good), "documents wrongly marked", false / len(decoys))
    assert hits / len(good) >= 0.9 and false / len(decoys) <= 0.1


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc")], "doc_id long, text string")
    assert pii.find_pii(docs).count() == 2
    assert pii.find_pii(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("a@b.cc", 1, 2, 3, "x")], "text string, _pii int, _piitext int, PII int, _pii_text string")
    row = pii.redact(pii.find_pii(named)).first()
    assert (row["_pii"], row["_piitext"], row["_pii_text"], row["redacted"]) == (1, 2, "x", "[email]") and len(row) == 6


def test_reliabilities(spark):
    texts = ["mail me: anna%d@mail.com soon" % i for i in range(60)] + ["go 4000 1234 5678 %04d 1" % i for i in range(60)]
    docs = common.pin(pii.with_candidates(spark.createDataFrame([(t,) for t in texts], "text string")), "test-candidates")
    model = pii.fit(docs)
    assert model.reliabilities["email"]["context"][0] > 0.8
    counts = docs.select(F.explode("candidates").alias("s")).where("s.base").count()
    assert counts >= 60


def plain_model(rows, rounds=50):
    """Expectation-maximisation over single candidates (votes of one kind), each a row of its own, in arrays."""
    votes = np.array(rows)
    start = {(x, y): np.array([0.1 if y else 0.6, 0.3, 0.6 if y else 0.1]) for x in range(votes.shape[1]) for y in (0, 1)}  # against, none, for
    given, share = dict(start), 0.5
    for _ in range(rounds):
        p = plain_posteriors(votes, share, given)
        share = (p.sum() + 2) / (len(p) + 4)
        for (x, y), prior in start.items():
            weight = p if y else 1 - p
            seen = 8 * prior + np.array([weight[votes[:, x] == v].sum() for v in (-1, 0, 1)])
            given[x, y] = seen / seen.sum()
    return share, given


def plain_posteriors(votes, share, given):
    yes, no = (np.full(len(votes), s) for s in (share, 1 - share))
    for x in range(votes.shape[1]):
        yes, no = yes * given[x, 1][votes[:, x] + 1], no * given[x, 0][votes[:, x] + 1]
    return yes / (yes + no)


def gradient(weights, on, target, weight, ridge=0.01):
    """That of the mean log-likelihood with soft targets, less the ridge, over one-hot rows."""
    return on.T @ (weight * (target - 1 / (1 + np.exp(-on @ weights)))) - ridge * weights


def test_model_against_plain_expectation_maximisation(spark):
    """Posteriors and reliabilities of the counted form are those over single candidates; the classifier is near the
    optimum of its loss, and Spark scores with its weights."""
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += [f"please mail anna{i} [at] example [dot] org, or phone: (0{30 + i}) 555-12{10 + i}; release 20{10 + i}.11.12 at noon dot and {i}" for i in range(40)]
    docs = common.pin(pii.with_candidates(spark.createDataFrame([(t,) for t in texts], "text string")), "test-candidates")
    model = pii.fit(docs)
    spans = [r["s"] for r in docs.select(F.explode("candidates").alias("s")).collect()]
    assert len({s["rank"] for s in spans}) == len(pii.KINDS)
    for rank, kind in enumerate(pii.KINDS):
        mine = [s for s in spans if s["rank"] == rank]
        votes = np.array([[s[x] for x in pii.LABELERS] for s in mine])
        share, given = plain_model(votes)
        for x, name in enumerate(pii.LABELERS):
            assert model.reliabilities[kind][name] == pytest.approx((given[x, 1][2], given[x, 0][0]), abs=1e-9)
        as_dict = {(x, bool(y), v): given[x, y][v + 1] for x, y in given for v in (-1, 0, 1)}
        plain = plain_posteriors(votes, share, given)
        assert [pii._posterior(tuple(v), share, as_dict) for v in votes.tolist()] == pytest.approx(np.clip(plain, 1e-13, 1), abs=1e-9)
        # the rows the classifier is fitted to: distinct patterns by the logarithm of their count, and the anchors
        seen = Counter((tuple(v), s["size"], s["shape"]) for v, s in zip(votes.tolist(), mine))
        anchors = [((*[v if i == x else 0 for i in range(5)],), s, s % pii.SHAPES, 1) for x in range(5) for v in (-1, 0, 1) for s in range(pii.SIZES)]
        rows = [(*k, n) for k, n in seen.items()] + anchors
        on = np.zeros((len(rows), 11 + pii.SIZES + pii.SHAPES))
        for i, (v, size, shape, _) in enumerate(rows):
            on[i, [0, 11 + size, 11 + pii.SIZES + shape, *[1 + 2 * x + (y == -1) for x, y in enumerate(v) if y]]] = 1
        weight = np.log1p([r[3] for r in rows])
        target = plain_posteriors(np.array([r[0] for r in rows]), share, given)
        weights = np.zeros(on.shape[1])
        for _ in range(300):
            weights = weights + 2 * gradient(weights, on, target, weight / weight.sum())
        assert model.weights[rank] == pytest.approx(weights.tolist(), abs=1e-9)
        assert np.abs(gradient(weights, on, target, weight / weight.sum())).max() < 2e-3
    scored = docs.select(F.explode("candidates").alias("s")).select("s", model.probability(F.col("s")).alias("p")).collect()
    for r in scored:
        w, s = model.weights[r["s"]["rank"]], r["s"]
        on = [0, 11 + s["size"], 11 + pii.SIZES + s["shape"], *[1 + 2 * x + (s[n] == -1) for x, n in enumerate(pii.LABELERS) if s[n]]]
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-sum(w[i] for i in on))), abs=1e-9)
