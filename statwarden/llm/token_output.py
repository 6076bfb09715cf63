"""Token ids as one wavelet matrix per shard.

Documents are range-partitioned by doc_id and encoded in that order. A shard is
one row of a Parquet table and holds one compressed file: the ids' bits as planes, each
a stable split of the one before it by its bit, with counts of ones per block of 512 bits.
The planes give any token, the number of times an id occurs before a position, and the
place of its k-th occurrence, without other copies of the ids. Reading back decodes the planes.

Defined cases: a null text counts as empty and has only the end id; null doc_ids come first; rows of equal
doc_id are ordered by text; other columns are not read; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import folder, give_back
from statwarden.llm.token_counts import vocabulary

END_ID = 2
# a shard is closed at so many ids; a single document may exceed it
SHARD_IDS = 1 << 19
BLOCK = 512
# texts are encoded together up to so many bytes, as a word that comes often in them is encoded once; a single batch may exceed it
CHUNK_BYTES = 4 << 20
# letters whose lower case and splitting are the same in Arrow and in the library, and ASCII marks, which split as one run behind them
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
SIMPLE = rf"^(?P<word>[{LETTERS}]+|[0-9]+)(?P<marks>[{re.escape(MARKS)}]*)\z"


class WaveletMatrix:
    """Bit planes of a sequence, most significant first, with rank and select."""

    def __init__(self, planes: np.ndarray, zeros: np.ndarray, n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @functools.cached_property
    def ones(self) -> np.ndarray:
        """Ones before each block; not needed to read the whole sequence."""
        return _block_ones(self.planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        level, planes, zeros = np.asarray(ids, _width(bits)), [], []
        for shift in range(bits - 1, -1, -1):
            bit = (level & level.dtype.type(1 << shift)).astype(bool)
            planes.append(_packed(bit))
            # places are taken by number, which is faster than by a mask of random bits
            zero = np.flatnonzero(~bit)
            zeros.append(len(zero))
            level = np.concatenate([level.take(zero), level.take(np.flatnonzero(bit))])
        return cls(np.array(planes, np.uint8).reshape(bits, -1), np.array(zeros, np.int64), len(ids))

    def _rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position: block counts, then the bits of one block."""
        at = np.asarray(at)
        block = at // BLOCK
        width = BLOCK // 8
        rows = self.planes[plane].reshape(-1, width)
        inside = np.unpackbits(rows[np.minimum(block, len(rows) - 1)], axis=1)
        mask = np.arange(BLOCK) < (at - block * BLOCK)[:, None]
        return self.ones[plane][block] + (inside * mask).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for plane in range(len(self.planes)):
            bit = self.planes[plane][at >> 3] >> (7 - (at & 7)) & 1
            rank = self._rank(plane, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[plane] + rank, at - rank)
        return out

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        low, high = 0, stop
        for plane in range(len(self.planes)):
            a, b = self._rank(plane, np.array([low, high]))
            if value >> (len(self.planes) - 1 - plane) & 1:
                low, high = int(self.zeros[plane] + a), int(self.zeros[plane] + b)
            else:
                low, high = int(low - a), int(high - b)
        return low, high

    def count(self, value: int, stop: int | None = None) -> int:
        """Occurrences of an id before ``stop``."""
        low, high = self._range(value, self.n if stop is None else stop)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, counted from 0."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = value >> (len(self.planes) - 1 - plane) & 1
            bits = np.unpackbits(self.planes[plane], count=self.n)
            at = int(np.flatnonzero(bits == one)[at - (self.zeros[plane] if one else 0)])
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the last plane up: each undoes the split below it."""
        values = np.zeros(self.n, _width(len(self.planes)))
        for shift, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(plane, count=self.n).view(bool)
            level = np.empty_like(values)
            level[np.flatnonzero(~one)] = values[:zeros]
            level[np.flatnonzero(one)] = values[zeros:] | values.dtype.type(1 << shift)
            values = level
        return values.astype(np.uint32)


def _width(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def _packed(bit: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(len(bit), 1) // BLOCK) * BLOCK, bool)
    padded[: len(bit)] = bit
    return np.packbits(padded)


def _block_ones(planes: np.ndarray) -> np.ndarray:
    per = np.unpackbits(planes, axis=1).reshape(len(planes), -1, BLOCK).sum(axis=2, dtype=np.int64)
    return np.concatenate([np.zeros((len(planes), 1), np.int64), np.cumsum(per, axis=1)], axis=1)


HEAD = np.dtype([("ids", "<u8"), ("bits", "<u4"), ("documents", "<u4")])


def to_file(lists: list[np.ndarray], doc_ids: list[int | None], bits: int) -> bytes:
    """Head, documents (id, whether it has one, length), zeros and planes; compressed as one."""
    ids = np.concatenate(lists)
    matrix = WaveletMatrix.build(ids, bits)
    parts = [
        np.array([(len(ids), bits, len(lists))], HEAD),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.array([len(x) for x in lists], "<i8"),
        matrix.zeros.astype("<i8"), matrix.planes,
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def from_file(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, bits, documents = (int(x) for x in np.frombuffer(raw, HEAD, 1)[0])
    at = HEAD.itemsize

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, known, lengths = take("<i8", documents), take("u1", documents), take("<i8", documents)
    zeros = take("<i8", bits)
    planes = np.frombuffer(raw, np.uint8, offset=at).reshape(bits, -1)
    return WaveletMatrix(planes, zeros, n), [int(d) if k else None for d, k in zip(doc_ids, known)], lengths


class Encoder:
    """Ids of whole texts; the distinct words of many texts are encoded by the library, each once.

    No token of this tokenizer spans white space and no special token holds any, so the
    ids of a text are those of its words in order. Words are split and told apart by Arrow.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.bits = (self.tokenizer.get_vocab_size() - 1).bit_length()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x100) if re.fullmatch(f"[{LETTERS}]", chr(c))]
        self.mapped = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self.digits = {str(d): self.encode(str(d)) for d in range(10)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def model_ids(self, letters: str) -> list[int]:
        """The library's model on lower-case letters, without its general text steps; a digit is a token of its own."""
        if letters[0] in self.digits:
            return [i for d in letters for i in self.digits[d]]
        return [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(self.mapped))]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and their numbers: simple ones are told apart without case and marks first."""
        parts = pc.extract_regex(words, SIMPLE)
        simple = parts.is_valid()
        low = pc.utf8_lower(pc.struct_field(parts, "word").filter(simple)).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(simple).dictionary_encode()
        flat, sizes = array("I"), array("q")
        for encode, pieces in ((self.model_ids, low.dictionary), (self.encode, marks.dictionary), (self.encode, words.filter(pc.invert(simple)))):
            for piece in pieces.to_pylist():
                ids = encode(piece) if piece else ()
                flat.extend(ids)
                sizes.append(len(ids))
        # a word has two pieces, of which the second may be empty; the last piece of all is
        sizes.append(0)
        simple = simple.to_numpy(zero_copy_only=False)
        pieces = np.full((len(words), 2), len(sizes) - 1)
        pieces[simple, 0] = low.indices.to_numpy()
        pieces[simple, 1] = marks.indices.to_numpy() + np.int64(len(low.dictionary))
        pieces[~simple, 0] = len(low.dictionary) + len(marks.dictionary) + np.arange(int((~simple).sum()))
        size = np.frombuffer(sizes, np.int64)
        return laid(np.frombuffer(flat, np.uint32), size, pieces.reshape(-1)), size[pieces].sum(axis=1)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where each one begins, with the end of the last."""
        # offsets of 64 bits: words of a large batch may be more than 32 bits count
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " "), " ")
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        words = lists.flatten().dictionary_encode()
        del lists
        codes = words.indices.to_numpy()
        flat, sizes = self.word_ids(words.dictionary)
        del words
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return laid(flat, sizes, codes), ends[per_text]

    def ids(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]))[0]


def laid(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The pieces that ``codes`` number, end to end; ``flat`` has each piece once. Done in steps, as places take more room than ids."""
    first, out = np.cumsum(sizes) - sizes, [np.zeros(0, np.uint32)]
    for low in range(0, len(codes), step):
        some = codes[low : low + step]
        size = sizes[some]
        ends = np.cumsum(size)
        out.append(flat[np.repeat(first[some] - (ends - size), size) + np.arange(ends[-1])])
    return np.concatenate(out)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


@functools.lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


SHARDS = "part int, shard int, ids long, documents long, file binary"


def write_shards(docs: DataFrame, file: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes ``docs`` in ascending doc_id order into the shards of a table at ``path``."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(file), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        lists, doc_ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            rows = [[part], [shard], [size], [len(lists)], [to_file(lists, doc_ids, encode.bits)]]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "shard", "ids", "documents", "file"])

        for batch in chunks(batches):
            found, bounds = encode.batch(batch.column("text"))
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = np.concatenate([found[low:high], end])
                if lists and size + len(ids) > shard_ids:
                    yield close()
                    lists, doc_ids, size, shard = [], [], 0, shard + 1
                lists.append(ids)
                doc_ids.append(doc_id)
                size += len(ids)
            found = None
            give_back()
        if lists:
            yield close()
        lists.clear()
        give_back()

    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)
    heads = shards.select("part", "shard", "ids")
    parts = heads.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("part_start"))
    inside = F.sum("ids").over(W.partitionBy("part").orderBy("shard")) - F.col("ids")
    starts = heads.withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file"))):
                matrix, doc_ids, lengths = from_file(data)
                ids = memoryview(matrix.tokens().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends, lengths)]
                cols = [np.full(len(ends), part, np.int32), np.full(len(ends), shard, np.int32), pa.array(doc_ids, pa.int64()), ends - lengths, lengths, pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])
        give_back()

    rows = shards.select("part", "shard", "file").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, file: str | None = None, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or folder(spark, "token-shards")
    write_shards(docs, file or vocabulary("word_bpe_49k.json"), path)
    return read_shards(spark, path)


@query("op7_token_output")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
