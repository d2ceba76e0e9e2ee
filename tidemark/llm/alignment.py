"""Alignment of two tokenizers' ids over the same bytes.

A text is a space and its characters, encoded by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback (B).
Where tokens of both end at the same byte is a cut; the tokens between cuts form a group, and every A token of a group is
linked with every B token of it.

Ends come from the tokenizers' own spans: character offsets of A, turned to bytes by the lengths of the characters before
them, and the byte spans of B's pieces. They are coarse: tokens that share a character have the same span, and byte-fallback
pieces have none until their character is complete. There the ends are refined by the tokens' decoded bytes. All tokens'
decoded bytes together must be the text's; a text for which they are not has no tokens.

Neither vocabulary joins characters over white space, so a text is cut at every single space or line feed between other
characters, and the distinct pieces of a slice are encoded once: a text's tokens, groups and links are those of its pieces
in a row. Texts with other runs of white space, or with a piece whose bytes differ, are encoded whole.

A document's distinct links and how often it has them are pinned once, as a row for each document. How many documents hold a
pair of ids is counted from them, summed in each task before anything is shuffled. The table of pairs (at most the
product of the vocabularies, in practice little more than a document has) is then brought to the documents in slices of
``TABLE_ROWS`` pairs, a pass for each slice, so that it may have any size and a pair that nearly every document holds is no
task's burden.

A null or empty text has no tokens: zeros and an empty digest. Very long texts take linear time, as one slice. Repeated rows are
rows of their own and counted each. Ties for an A id's highest count all count as best. An empty table gives no rows. Only the
id and the text are read; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common
from tidemark.llm.words import cuts, held

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs that are broadcast at once (13 bytes each).
TABLE_ROWS = 1 << 22
#: Text in a slice, and pieces that a worker keeps.
SLICE_BYTES = 1 << 22
CACHE_PIECES = 3 << 17
#: Characters whose encodings are held at once.
BATCH_CHARS = 1 << 15
_SPACE = "▁"
#: White space (as the tokenizers' patterns have it) beside white space, or at either end; and the sign that B has for a space.
_ODD = r"[\s\x0b\x{85}\p{Z}][\s\x0b\x{85}\p{Z}]|^[\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}]$|[\x1c-\x1f]|" + _SPACE


class Pieces(NamedTuple):
    """Stretches of text: whether their bytes are right, their tokens (A, B), groups and links, the groups as text, and their
    links in a row, those of the i-th from ``first[i]`` on."""

    right: np.ndarray
    sizes: np.ndarray
    groups: list[str]
    first: np.ndarray
    links: np.ndarray


def _none() -> Pieces:
    return Pieces(np.zeros(0, bool), np.zeros((0, 4), np.int32), [], np.zeros(1, np.int64), np.zeros(0, np.int32))


def _chained(parts: list[Pieces]) -> Pieces:
    links = np.concatenate([p.links for p in parts])
    sizes = np.concatenate([p.sizes for p in parts])
    return Pieces(np.concatenate([p.right for p in parts]), sizes, [g for p in parts for g in p.groups], np.concatenate([[0], np.cumsum(sizes[:, 3], dtype=np.int64)]), links)


class _Bytes:
    """The bytes of all ids of a vocabulary in a row."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.first[ids], self.size[ids])]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then those from first[1] on, and so on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _since(exact: np.ndarray, ends: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``ends`` where they are exact; elsewhere the last exact end of the same text, or its start, and the bytes since."""
    n = len(ends)
    at = np.arange(n)
    begun = np.zeros(n, bool)
    begun[starts[starts < n]] = True
    base = np.maximum.accumulate(np.where(exact | begun, at, 0))  # an exact token, or the first of its text
    upto = np.cumsum(sizes)
    fresh = begun[base] & ~exact[base]
    return np.where(exact, ends, np.where(fresh, upto - upto[base] + sizes[base], ends[base] + upto - upto[base]))


class Aligner:
    """Both tokenizers, the bytes of their ids, and the pieces seen of late."""

    def __init__(self, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes of the byte-level alphabet that stand for themselves
        rest = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = self.a.get_vocab()
        words = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            words[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_a = _Bytes(words)
        self.n_b = self.b.vocab_size()
        self.is_byte = np.array([self.b.is_byte(i) for i in range(self.n_b)])
        self.bytes_b = _Bytes([bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(_SPACE, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.n_b))])
        self.lone = self.b.piece_to_id(_SPACE)
        # a token as text and what follows it: another of its side, the other side or group
        self.signs = [f"{i}{sign}" for n, signs in ((len(words), ",|"), (self.n_b, ",;")) for i in range(n) for sign in signs]
        self.seen: dict[str, int] = {}
        self.used = np.zeros(0, np.int64)
        self.store = _none()

    def _encoded_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, the byte ends of their tokens and the first token of each text."""
        found = self.a.encode_batch(texts, add_special_tokens=False)
        count = np.array([len(e) for e in found], np.int64)
        total, starts = int(count.sum()), np.cumsum(count) - count
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), np.int64, total)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable([e.offsets for e in found])), np.int64, 2 * total).reshape(-1, 2)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        upto = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])  # bytes before each character
        chars = np.array([len(t) for t in texts], np.int64)
        zero = np.repeat(np.cumsum(chars) - chars, count)
        ends = upto[zero + spans[:, 1]] - upto[zero]
        exact = np.ones(total, bool)  # a token that shares its last character with the next ends inside it
        exact[:-1] = spans[1:, 0] >= spans[:-1, 1]
        exact[np.append(starts[1:], total) - 1] = True
        return ids, _since(exact, ends, self.bytes_a.size[ids], starts), starts

    def _encoded_b(self, texts: list[str], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_encoded_a`; and whether a joined text begins with the lone space that B adds, which is taken off."""
        protos = self.b.encode(texts, return_type="proto", num_threads=1)
        ids_, ends_, count_ = [], [], []
        for p in protos:
            pieces = list(p.pieces)  # each is made anew when it is asked for
            count_.append(len(pieces))
            ids_ += [x.id for x in pieces]
            ends_ += [x.end for x in pieces]
        ids, ends, count = (np.array(x, np.int64) for x in (ids_, ends_, count_))
        starts = np.cumsum(count) - count
        right = np.ones(len(texts), bool)
        if joined.any():
            right[joined] = (count[joined] > 0) & (ids[np.minimum(starts[joined], len(ids) - 1)] == self.lone) if len(ids) else False
            keep = np.ones(len(ids), bool)
            keep[starts[joined & right]] = False
            ids, ends, count = ids[keep], ends[keep], count - (joined & right)
            starts = np.cumsum(count) - count
        ends = ends + np.repeat(~joined, count)  # the space that B adds is a byte before all spans
        return ids, _since(~self.is_byte[ids], ends, self.bytes_b.size[ids], starts), starts, right

    def align(self, texts: list[str], joined: np.ndarray) -> Pieces:
        """Texts that stand after a space of their own or, if ``joined``, after another character."""
        parts = []
        sizes = np.cumsum([len(t) for t in texts])
        a = 0
        while a < len(texts):  # encodings of few texts at a time: each is an object of its tokenizer
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH_CHARS, "right")))
            parts.append(self._align(texts[a:b], joined[a:b]))
            a = b
        return _chained(parts) if parts else _none()

    def _align(self, texts: list[str], joined: np.ndarray) -> Pieces:
        n = len(texts)
        whole = [t if j else " " + t for t, j in zip(texts, joined.tolist(), strict=True)]
        raw = [t.encode("utf-8", "surrogatepass") for t in whole]
        size = np.array([len(r) for r in raw], np.int64)
        id_a, end_a, start_a = self._encoded_a(whole)
        id_b, end_b, start_b, right = self._encoded_b(texts, joined)
        row_a, row_b = (np.repeat(np.arange(n), np.diff(np.append(s, len(i)))) for s, i in ((start_a, id_a), (start_b, id_b)))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        for ids, row, table in ((id_a, row_a, self.bytes_a), (id_b, row_b, self.bytes_b)):
            length = np.bincount(row, table.size[ids], n).astype(np.int64)
            right &= length == size
            same = right[row]  # of those of the right length, the bytes
            mine = np.repeat(np.arange(n), np.where(right, size, 0))
            differ = table.joined(ids[same]) != flat[np.repeat(right, size)]
            right[mine[differ]] = False
        keep = right[row_a]
        id_a, end_a, row_a = id_a[keep], end_a[keep], row_a[keep]
        keep = right[row_b]
        id_b, end_b, row_b = id_b[keep], end_b[keep], row_b[keep]
        # a cut is an end of both; groups are numbered by the cuts before them, over all texts
        before = np.cumsum(size) - size
        at_a, at_b = before[row_a] + end_a, before[row_b] + end_b
        ends_a, ends_b = np.zeros((2, len(flat) + 1), bool)
        ends_a[at_a] = ends_b[at_b] = True
        cut_a, cut_b = ends_b[at_a], ends_a[at_b]
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_groups = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        partners = in_b[group_a]
        first_b, last_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        links = np.repeat(id_a, partners) * self.n_b + id_b[_ranges(first_b[group_a], partners)]
        sizes = np.stack([np.bincount(row_a, minlength=n), np.bincount(row_b, minlength=n), np.bincount(row_a[cut_a], minlength=n), np.bincount(row_a, partners, n).astype(np.int64)], axis=1)
        sign = np.empty(len(id_a) + len(id_b), np.int64)  # the A tokens of each group, then its B tokens
        sign[np.arange(len(id_a)) + first_b[group_a]] = 2 * id_a + cut_a
        sign[np.arange(len(id_b)) + last_a[group_b]] = 2 * len(self.bytes_a.words) + 2 * id_b + cut_b
        written = [self.signs[i] for i in sign.tolist()]
        ends = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        groups = ["".join(written[a:b])[:-1] for a, b in zip([0, *ends], ends)]
        kept = links.astype(np.int32) if self.n_b * len(self.bytes_a.words) < 1 << 31 else links  # a cache holds them
        return Pieces(right, sizes.astype(np.int32), groups, np.concatenate([[0], np.cumsum(sizes[:, 3])]), kept)

    def pieces(self, texts: list[str]) -> np.ndarray:
        """The places in :attr:`store` of distinct texts; those not seen of late are encoded. One that begins with a line feed
        follows another character."""
        if len(self.seen) > CACHE_PIECES:
            self._forget()
        new = [t for t in texts if t not in self.seen]
        if new:
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.store = _chained([self.store, self.align(new, np.array([t.startswith("\n") for t in new], bool))])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        places = np.array([self.seen[t] for t in texts], np.int64)
        self.used[places] += 1
        return places

    def _forget(self) -> None:
        """Keep the pieces that more than one slice had, unless they are most of all."""
        keep = self.used > 1
        if keep.sum() > CACHE_PIECES // 2:
            keep[:] = False
        names = [t for t, k in zip(self.seen, keep.tolist(), strict=True) if k]
        s = self.store
        links = s.links[_ranges(s.first[:-1][keep], s.sizes[keep, 3].astype(np.int64))]
        self.store = Pieces(s.right[keep], s.sizes[keep], [s.groups[i] for i in np.flatnonzero(keep).tolist()], np.concatenate([[0], np.cumsum(s.sizes[keep, 3], dtype=np.int64)]), links)
        self.seen, self.used = {t: i for i, t in enumerate(names)}, np.ones(len(names), np.int64)


class Aligned(NamedTuple):
    """Rows of a slice: counts, digests, and each row's distinct links with how often it has them."""

    counts: np.ndarray
    digests: list[str]
    rows: np.ndarray
    links: np.ndarray
    times: np.ndarray


def align_slice(aligner: Aligner, texts: pa.Array) -> Aligned:
    """Every text of a slice (none null), its distinct pieces encoded once."""
    m = len(texts)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd | empty), "", texts), "\n", " \n"), " ")
    found = split.flatten().dictionary_encode()
    starts = split.offsets.to_numpy() - split.offsets[0].as_py()
    place = aligner.pieces(found.dictionary.to_pylist())[found.indices.to_numpy()]
    store = aligner.store
    row = np.repeat(np.arange(m), np.diff(starts))
    again = odd | (np.bincount(row, ~store.right[place], m) > 0) & ~empty
    plain = ~(again | empty)
    use = plain[row]
    row, place = row[use], place[use]
    counts = np.stack([np.bincount(row, store.sizes[place, c], m) for c in range(4)], axis=1).astype(np.int64)
    digests, ends = [""] * m, np.searchsorted(row, np.arange(m + 1)).tolist()
    names = place.tolist()
    for i in np.flatnonzero(plain).tolist():
        digests[i] = hashlib.sha256(";".join([store.groups[c] for c in names[ends[i] : ends[i + 1]]]).encode()).hexdigest()
    each = store.sizes[place, 3].astype(np.int64)
    rows, links = [np.repeat(row, each)], [store.links[_ranges(store.first[place], each)]]
    for i in np.flatnonzero(again).tolist():
        p = aligner.align([texts[i].as_py()], np.zeros(1, bool))
        if p.right[0]:
            counts[i], digests[i] = p.sizes[0], hashlib.sha256(p.groups[0].encode()).hexdigest()
            rows.append(np.full(len(p.links), i))
            links.append(p.links)
    most = len(aligner.bytes_a.words) * aligner.n_b
    keys = np.sort(np.concatenate(rows) * most + np.concatenate(links))  # a slice has far fewer rows than 2^63 / most
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    distinct = keys[first]
    return Aligned(counts, digests, distinct // most, distinct % most, np.diff(np.append(first, len(keys))))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", paths: tuple[str, str] = (TOKENIZER_A, TOKENIZER_B)) -> DataFrame:
    """A row for each document: its counts and digest, and its distinct ``links`` (A id times B's size, plus B id) with their ``times``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("alignment", paths), lambda: Aligner(*paths))
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for first, last in cuts(texts, SLICE_BYTES):
                s = align_slice(aligner, texts.slice(first, last - first))
                at = pa.array(np.searchsorted(s.rows, np.arange(last - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), *[pa.array(s.counts[:, c]) for c in range(4)], pa.array(s.digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(s.links)), pa.ListArray.from_arrays(at, pa.array(s.times.astype(np.int32)))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"],
                )

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, ddl)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """link, n, best: how many documents hold each pair of ids, and whether that is its A id's highest count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            parts.append(np.unique(b.column(0).flatten().to_numpy(), return_counts=True))
            size += len(parts[-1][0])
            if size > 1 << 21:
                parts, size = [_summed(parts)], 0
                if len(parts[0][0]) > 1 << 20:
                    yield _batch(parts.pop())
        if parts:
            yield _batch(_summed(parts))

    counted = aligned.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    pairs = common.pin(counted.withColumn("a", F.expr(f"link div {n_b}")), "alignment-counts")
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return pairs.join(F.broadcast(top), "a").select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    links, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return links, np.bincount(at, np.concatenate([p[1] for p in parts]), len(links)).astype(np.int64)


def _batch(columns: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["link", "n"])


def weigh_links(aligned: DataFrame, pairs: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the documents, in as many passes as the pairs' table has slices."""
    spark = aligned.sparkSession
    pairs = common.pin(pairs, "alignment-pairs")
    passes = max(1, -(-pairs.count() * 5 // (table_rows * 4)))  # hash slices are not quite even
    out = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    columns = out.columns
    for k in range(passes):
        rows = pairs.where(F.pmod(F.xxhash64("link"), F.lit(passes)) == k).orderBy("link").toArrow() if passes > 1 else pairs.toArrow()
        link, n, best = (rows.column(c).to_numpy() for c in ("link", "n", "best"))
        order = np.argsort(link)
        table = spark.sparkContext.broadcast((link[order], n[order], best[order]))

        def add(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            keys, counts, bests = table.value
            for b in batches:
                lists = b.column(columns.index("links"))
                links, times = lists.flatten().to_numpy(), b.column(columns.index("times")).flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
                at = np.minimum(np.searchsorted(keys, links), max(0, len(keys) - 1))
                hit = keys[at] == links if len(keys) else np.zeros(len(links), bool)
                row, at, times = row[hit], at[hit], times[hit].astype(np.int64)
                sums = [np.zeros(b.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], row, times * bests[at])
                np.add.at(sums[1], row, times * counts[at])
                made = [pc.add(b.column(columns.index(c)), pa.array(s)) for c, s in zip(("n_best", "count_sum"), sums, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], columns)

        out = out.mapInArrow(add, out.schema)
        if k + 1 < passes:
            out = common.pin(out, "alignment-pass")
    return out


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = common.pin(align_documents(common.table(spark, sf_dir, "documents")), "aligned")
    n_b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B).vocab_size()
    weighed = weigh_links(aligned, pair_counts(aligned, n_b))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
