"""Exact token counts at every prefix of a text.

A byte-pair encoding is the only chain of pieces in which every neighbouring
pair encodes to itself. So the last piece of a prefix is the one piece ending
there that forms a stable pair with the last piece of the prefix before it, and

    count[i] = count[i - len(last piece)] + 1.

No piece holds a letter before a word mark or a line break, so segments between these
are independent: each distinct segment is worked out once per worker and memoised.
A text's table is the concatenation of its segments' count steps (one
signed byte per code point, compressed). Its running sum answers how many tokens any
prefix has and where a budget ends, without encoding again.

Defined cases: null text counts as empty and has no tokens; equal rows get equal rows;
columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import TwoGenerations, per_batch, written

MARK = "▁"  # the word mark, stands for a space
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
MEMO_SEGMENTS = 300_000
LIMIT = 4096


class PrefixCounter:
    """Prefix counts under one sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        pieces = [self.model.id_to_piece(i) for i in plain]
        # a line break is no piece, so nothing merges with the mark that the library puts first
        self.lead = len(self.model.encode("\n"))
        whole = self.model.encode(["\n" + p for p in pieces], num_threads=1)
        self.pieces = {p: i for p, i, ids in zip(pieces, plain, whole) if ids[self.lead :] == [i]}
        # every ending of a piece, with the id where it is a piece itself and -1 elsewhere
        self.tails = {p[i:]: -1 for p in self.pieces for i in range(len(p))} | self.pieces
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.names = {i: p for p, i in self.pieces.items()}
        self.stable = TwoGenerations(self.is_stable, 300_000)
        self.runs = TwoGenerations(self.run_steps, MEMO_SEGMENTS // 3)
        self.steps = TwoGenerations(self.segment_steps, MEMO_SEGMENTS)

    def is_stable(self, pair: tuple[int, int]) -> bool:
        """Whether two pieces side by side stay apart."""
        return self.model.encode("\n" + self.names[pair[0]] + self.names[pair[1]])[self.lead :] == list(pair)

    def segment_steps(self, segment: str) -> bytes:
        """Change of the token count at each code point of a segment, cut where no piece has the two characters side by side."""
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.joined]
        if not cuts:
            return self.run_steps(segment)
        return b"".join(self.runs[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)]))

    def run_steps(self, segment: str) -> bytes:
        tails, stable = self.tails.get, self.stable
        last, count, steps = [-1], [0], bytearray()
        for end in range(1, len(segment) + 1):
            for start in range(end - 1, -1, -1):
                piece = tails(segment[start:end])
                if piece is None:  # no piece ends like this, so no longer one does
                    start = -1
                    break
                # an entry of -1 is the start or a character without a piece: nothing merges across it
                if piece >= 0 and (last[start] < 0 or stable[last[start], piece]):
                    break
            else:
                start = -1
            if start >= 0:
                last.append(piece)
                count.append(count[start] + 1)
            else:  # no piece has this character: it falls back to its bytes
                last.append(-1)
                count.append(count[-1] + len(segment[end - 1].encode()))
            steps.append(count[-1] - count[-2] & 255)
        return bytes(steps)

    def text_steps(self, text: str) -> np.ndarray:
        """Change of the count at each code point; that of the library's leading mark is added to the first."""
        if not text:
            return np.zeros(0, np.int8)
        marked = MARK + text.replace(" ", MARK)
        steps = np.frombuffer(b"".join(map(self.steps.__getitem__, SEGMENT.findall(marked))), np.int8)
        out = steps[1:].copy()
        out[0] += steps[0]
        return out


@functools.lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def prefix_tables(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_bytes and ``steps``, the compressed count steps of the whole text."""

    def make():
        counts, packer = counter(model_file), zstandard.ZstdCompressor(level=1)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            packed = [packer.compress(counts.text_steps(t).tobytes()) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_bytes", "steps"]
            )

        return one

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, n_bytes long, steps binary", make)


def counts_of(steps: bytes) -> np.ndarray:
    """Token count of each prefix, the empty one first."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(steps), np.int8)
    return np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])


def budgets(tables: DataFrame, limit: int) -> DataFrame:
    """``n_tokens`` of the whole text and ``cut_chars``, the longest prefix of at most ``limit`` tokens."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            total, cut = [], []
            for steps in batch.column("steps").to_pylist():
                counts = counts_of(steps)
                total.append(int(counts[-1]))
                cut.append(int(np.flatnonzero(counts <= limit)[-1]))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64()), pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "cut_chars"]
            )

        return one

    return per_batch(tables, "doc_id long, n_bytes long, n_tokens long, cut_chars long", make)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = written(prefix_tables(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")), "prefix-tables")
    return budgets(tables, LIMIT).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_chars")
