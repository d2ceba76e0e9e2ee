"""Token-id files with Elias-Fano document boundaries.

Texts are encoded by their words: the vocabulary used here never joins characters over white space, so the ids of a text
are those of its words in a row. A slice of a batch is split by Arrow and each distinct word encoded once; the ids of the
texts are then gathered as arrays.

A shard file holds the ids of many documents in a row, as unsigned 16-bit (or 32-bit, by vocabulary) little-endian
integers, then two Elias-Fano sequences: the end offset of each document, and the document ids in ascending order.
An Elias-Fano sequence of n values below u takes about n (2 + log2(u/n)) bits: the low bits packed, the high bits in
unary. ``select`` finds the i-th value by a sampled directory of the unary bits, so no table of 64-bit offsets exists.

Shards are written by tasks straight to the shared folder, under names of their own; only the files named in the
manifest, which holds rows of tasks that ended well, are ever read. A lost executor leaves at most an orphan file.

A null text is an empty one (it still has the end id); a very long one is a slice of its own. Rows with a null id come
first. Repeated ids keep all rows, in the order of a hash of their text. An empty table gives an empty manifest. Columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common
from tidemark.llm.words import held, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
MAGIC = b"EFTOK001"
#: A shard is closed at the first document end after this many ids.
SHARD_IDS = 1 << 24
#: Or after this many documents.
SHARD_DOCS = 1 << 18
#: One select sample for this many values.
SAMPLE = 256
#: Words that a worker keeps of late; as many older ones stay until these are full again. Longer words are not kept.
CACHE_WORDS = 1 << 17
CACHE_LETTERS = 64
#: White space to Python and Arrow, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Signs that never join letters: all of ASCII but the apostrophe, which begins contractions.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """word -> its ids as bytes; words are made on first use."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{_SEPARATORS}]", *(re.escape(x) for x in special)])
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in own)
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def pack(self, tokens: list) -> bytes:
        return array(self.code, [t.id for t in tokens]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            if word.isalpha() and (word.isascii() or max(word) < "İ"):
                # letters of Latin-1 and the first of Extended-A: one run, lower-cased one by one, composed as they are
                low = word.lower()
                found = self.pack(self.tokenize(low if low.isascii() else "".join(map(self.alphabet.__getitem__, low.encode()))))
            else:
                stem = word.rstrip(_SIGNS)
                if stem and len(stem) < len(word) and stem[-1].isalpha() and stem[-1].isascii():
                    return self[stem] + self[word[len(stem) :]]  # letters end where these signs begin
                stem = word.lstrip(_SIGNS)
                if stem and len(stem) < len(word) and stem[0].isalpha() and stem[0].isascii():
                    return self[word[: -len(stem)]] + self[stem]
                found = self.whole(word)
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str):
        if re.search(self.odd, text):
            return self.whole(text)
        return b"".join([self[w] for w in text.split()])

    def sliced(self, texts: pa.Array) -> Iterator[tuple]:
        """Slices, those of their rows that must be encoded whole, and what each of their words has."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)  # the tokenizer does so too
        mask = pc.match_substring_regex(low, self.odd)
        odd: dict[int, str] = {}
        if pc.any(mask).as_py():
            odd = dict(zip(np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist(), texts.filter(mask).to_pylist(), strict=True))
            low = pc.if_else(mask, "", low)
        for s in slices(low):
            yield s, {i - s.first: t for i, t in odd.items() if s.first <= i < s.first + len(s.texts)}, [self[w] for w in s.words]

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text."""
        for s, odd, found in self.sliced(texts):
            size = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
            first, n = np.cumsum(size) - size, size[s.codes]
            at = np.cumsum(n) - n
            ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(first[s.codes] - at, n) + np.arange(int(n.sum()))]
            ends = np.concatenate([at, [len(ids)]])[s.starts]
            for i in range(len(s.texts)):
                yield self.whole(odd[i]) if i in odd else ids[ends[i] : ends[i + 1]].tobytes()


class WordLengths(WordIds):
    """word -> how many ids it has."""

    def pack(self, tokens: list) -> int:
        return len(tokens)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        counts = [np.zeros(0, np.int64)]
        for s, odd, found in self.sliced(texts):
            n = s.sums(np.array(found, float)).astype(np.int64)
            for i, t in odd.items():
                n[i] = self.whole(t)
            counts.append(n)
        return np.concatenate(counts)


def word_ids(path: str) -> WordIds:
    """The worker's own encoder for a vocabulary file."""
    return held(("word ids", path), lambda: WordIds(path))


def n_tokens(text: str | Column = "text", path: str = TOKENIZER) -> Column:
    """How many ids a text has; 0 for null."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(held(("word lengths", path), lambda: WordLengths(path)).lengths(texts))

    return count(F.col(text) if isinstance(text, str) else text)


# -- Elias-Fano ---------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        #: bytes of the unary part before which so many ones have been seen, and their bit positions, once per SAMPLE
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.samples = np.searchsorted(ones, np.arange(0, max(n, 1), SAMPLE), side="right") - 1
        self.before = ones[self.samples]

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        values = values.astype(np.uint64)
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if int(values[-1]) >= n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
        unary = np.zeros(int(values[-1] >> np.uint64(low_bits)) + n, np.uint8)
        unary[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"))

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first = a * self.low_bits // 8
        bits = np.unpackbits(self.low[first : (b * self.low_bits + 7) // 8], bitorder="little")
        skip = a * self.low_bits - first * 8
        bits = bits[skip : skip + (b - a) * self.low_bits].reshape(b - a, self.low_bits).astype(np.int64)
        return bits @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b, exclusive: a jump to the sample before a, then the unary bits up to b."""
        if a >= b:
            return np.zeros(0, np.int64)
        s, e = a // SAMPLE, (b - 1) // SAMPLE + 1
        at = int(self.samples[s])
        to = int(self.samples[e]) + 1 if e < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:to], bitorder="little"))[a - int(self.before[s]) :][: b - a] + at * 8
        return ((ones - np.arange(a, b)) << self.low_bits) | self._lows(a, b)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<QQQQ", data, at)
        low = np.frombuffer(data, np.uint8, n_low, at + 32)
        high = np.frombuffer(data, np.uint8, n_high, at + 32 + n_low)
        return cls(n, low_bits, low, high), at + 32 + n_low + n_high


# -- shard files --------------------------------------------------------------------------------------------------


class ShardWriter:
    """ids first, as they come; the boundaries and a footer last, so that nothing is held but the lengths."""

    def __init__(self, folder: str, dtype: np.dtype):
        self.path = f"{folder}/{uuid.uuid4().hex}.tokens"
        self.fs, at = common.file_system(self.path)
        self.out = self.fs.open_output_stream(at)
        self.out.write(MAGIC)
        self.dtype, self.ends, self.docs, self.ids, self.nulls = dtype, [], [], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.ids += len(data) // self.dtype.itemsize
        self.ends.append(self.ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> dict:
        docs = np.array(self.docs, np.int64)
        base = int(docs[0]) if len(docs) else 0
        tail = EliasFano.build(np.array(self.ends, np.int64)).to_bytes() + EliasFano.build((docs - base).astype(np.uint64)).to_bytes()
        head = json.dumps({"dtype": self.dtype.str, "nulls": self.nulls, "base": base, "tail": len(tail)}).encode()
        self.out.write(tail + head + struct.pack("<Q", len(head)) + MAGIC)
        self.out.close()
        return {"path": self.path, "n_docs": len(self.ends), "n_ids": self.ids}


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str):
        fs, at = common.file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n_head, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.head = json.loads(self.file.read_at(n_head, size - 16 - n_head))
        tail = self.file.read_at(self.head["tail"], size - 16 - n_head - self.head["tail"])
        self.dtype = np.dtype(self.head["dtype"])
        self.ends, at = EliasFano.from_bytes(tail)
        self.docs, _ = EliasFano.from_bytes(tail, at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.head["nulls"] else self.docs.select(i - self.head["nulls"]) + self.head["base"]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.ends.select(i - 1) if i else 0, self.ends.select(i)
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, len(MAGIC) + a * self.dtype.itemsize), self.dtype)

    def scan(self, block: int = 1024) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place, ids) of every document, read a block of documents at a time."""
        start, nulls = 0, self.head["nulls"]
        for a in range(0, len(self), block):
            b = min(a + block, len(self))
            docs = [None] * max(0, min(b, nulls) - a) + (self.docs.slice(max(a - nulls, 0), max(b - nulls, 0)) + self.head["base"]).tolist()
            for doc, end in zip(docs, self.ends.slice(a, b).tolist(), strict=True):
                raw = self.file.read_at((end - start) * self.dtype.itemsize, len(MAGIC) + start * self.dtype.itemsize)
                yield doc, start, np.frombuffer(raw, self.dtype)
                start = end


def write_token_files(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents in ascending id order; returns the manifest: path, start (ids before the shard), n_docs, n_ids.

    The rows are ranged over tasks by id and a hash of the text, so rows that share an id (or have none) are spread too and
    have one order; they are sorted and streamed. Shards are numbered by task and then by place. The manifest has one row for
    each shard. Other columns than the two are ignored.
    """
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    sorted_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = sorted_docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = word_ids(path), TaskContext.get().partitionId()
        end, done, shard = array(enc.code, [end_id]).tobytes(), [], None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1)), strict=True):
                shard = shard or ShardWriter(folder, enc.dtype)
                shard.add(doc_id, ids + end)
                if shard.ids >= shard_ids or len(shard.ends) >= SHARD_DOCS:
                    done.append(shard.close())
                    shard = None
        if shard:
            done.append(shard.close())
        rows = [{"task": task, "seq": i, **d} for i, d in enumerate(done)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = common.pin(sorted_docs.mapInArrow(write, "task int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block: list[tuple] = []
                for doc, at, ids in ShardReader(path).scan():
                    block.append((doc, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(block) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], NAMES)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], NAMES)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


NAMES = ["doc_id", "start", "n_tokens", "ids_crc32"]


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.workdir(spark, "tokens")
    return read_token_files(write_token_files(common.table(spark, sf_dir, "documents"), folder))
