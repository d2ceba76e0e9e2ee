"""Alignment against both tokenizers' decoded bytes, text by text."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import alignment, common

TEXTS = [
    "plain words here", "one\nline\nafter another", "é漢字😀 <0x0A> <s> <|endoftext|> x", "  lead trail  ", "a▁b", "tab\tx", "ﬁ Å é", "a\xa0b　c", "", None, " ", "\n", "x ", "x\n", "\nx", "a  b", "a \nb", "a\n\nb",
    "don't they're I'LL", "number 12345 67,890.12", "!!! ... ??? ###", "naïve café – “quotes” … ", "Ωμέγα привет שלום مرحبا नमस्ते ไทย", "🏳️‍🌈 family 👨‍👩‍👧", "x\x00y \x7f \x85z \x1c w", "word " * 3000 + "end", "👩" * 500, "ab" * 4000,
    "same text", "same text", "crlf\r\nhere", "  sep", "zero​width ﻿bom", "q" * 300,
]


def plain(rows):
    """The contract, from whole encodings and decoded bytes alone."""
    al = alignment.Aligner()
    docs, found = [], []
    for doc_id, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
            if b"".join(al.bytes_a.words[i] for i in a) == raw == b"".join(al.bytes_b.words[i] for i in b):
                ends = []
                for ids, table in ((a, al.bytes_a), (b, al.bytes_b)):
                    at, upto = 0, []
                    for i in ids:
                        at += len(table.words[i])
                        upto.append(at)
                    ends.append(upto)
                last = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    now = [e.index(cut) + 1 for e in ends]
                    groups.append((a[last[0] : now[0]], b[last[1] : now[1]]))
                    last = now
        docs.append((doc_id, groups))
        found.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    held, best = Counter(), defaultdict(int)
    for f in found:
        held.update(f.keys())
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, groups), f in zip(docs, found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(f.values()), sum(n for p, n in f.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in f.items()), digest))
    return out


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def aligned(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("n_a", "links", "times", "n_best", "link", "best")}).repartition(3)
    done = common.pin(alignment.align_documents(docs), "aligned")
    return rows_of(alignment.weigh_links(done, alignment.pair_counts(done, alignment.Aligner().n_b), **more))


def test_hard_texts(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(TEXTS)]
    key = lambda r: tuple(map(str, r))
    assert sorted(aligned(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_slices_of_the_table_give_the_same(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    assert sorted(aligned(spark, rows, table_rows=150)) == sorted(plain(rows))


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SMALL, "documents").collect()]
    assert sorted(rows_of(alignment.op13_alignment(spark, SMALL))) == sorted(plain(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    done = common.pin(alignment.align_documents(docs), "aligned")
    assert alignment.weigh_links(done, alignment.pair_counts(done, 32000)).count() == 0


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_spans_and_bytes_agree(text):
    """Ends from refined spans are those of decoded bytes."""
    al = alignment.Aligner()
    e, p = al.a.encode(" " + text, add_special_tokens=False), al.b.encode(text, return_type="proto")
    ids = [x.id for x in p.pieces]
    if b"".join(al.bytes_b.words[i] for i in ids) == (" " + text).encode():
        for made, table, expected in ((al._encoded_a(["x", " " + text, ""]), al.bytes_a, e.ids), (al._encoded_b(["x", text, ""], np.zeros(3, bool)), al.bytes_b, ids)):
            got, ends, starts = made[:3]
            assert got[starts[1] : starts[2]].tolist() == expected
            assert ends[starts[1] : starts[2]].tolist() == np.cumsum(table.size[expected]).tolist()
