"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and from bad labelled texts. A
text is cut into chunks, each compressed once with either dictionary; what the
good dictionary saves over the bad one, as a share of the text, is the main feature, beside the sizes
themselves (text that repeats itself shrinks under both). A logistic
calibration on other labelled texts turns them into a score.

Training reads at most ``PER_CLASS`` texts of each class; every document is scored over its whole text.

Defined cases: null text counts as empty; an empty text has all sizes zero and is scored like any other; equal rows get equal
rows; without labels of both classes the score is constant; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.labelled import fitted, fold, logistic, probability
from statwarden.llm.registry import query, table
from statwarden.llm.shared import per_batch

PER_CLASS = 1500
DICTIONARY_BYTES = 96 << 10
LARGEST_PIECE = 256
CHUNK = 512
FEATURES = 9


def dictionary(texts: list[str]) -> bytes:
    """An equal piece of each text, from its middle: openings are often shared and say little of quality."""
    room = min(LARGEST_PIECE, max(64, DICTIONARY_BYTES // max(1, len(texts))))
    raw = [t.encode() for t in texts]
    return b"".join(r[max(0, (len(r) - room) // 2) :][:room] for r in raw)[:DICTIONARY_BYTES]


class CompressionClassifier:
    """Sizes under both dictionaries, and the calibration of their difference."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.weights = good, bad, None
        self.mean = self.scale = None

    def packers(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=3)
            out.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the normalised size difference over all chunks and in the most extreme ones, the sizes, and squares."""
        good, bad = self.packers()
        empty = len(good.compress(b""))
        out = np.zeros((len(texts), FEATURES))
        for i, text in enumerate(texts):
            raw = text.encode()
            chunks = [raw[a : a + CHUNK] for a in range(0, len(raw), CHUNK)]
            if not chunks:
                continue
            n = np.array([len(c) for c in chunks])
            g = np.array([len(good.compress(c)) - empty for c in chunks])
            b = np.array([len(bad.compress(c)) - empty for c in chunks])
            # a chunk that is cut short counts by its length
            each = (g - b) / np.maximum(n, CHUNK // 2)
            gain, size_good, size_bad = (g.sum() - b.sum()) / n.sum(), g.sum() / n.sum(), b.sum() / n.sum()
            out[i] = gain, (g.sum() - b.sum()) / max(1, g.sum() + b.sum()), size_good, size_bad, each.max(), each.min(), gain * size_good, size_good**2, size_bad**2
        return out

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        x = self.features(texts) if texts else np.zeros((0, FEATURES))
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.weights = logistic((x - self.mean) / self.scale, labels, ridge=0.1)

    def score(self, texts: list[str]) -> np.ndarray:
        return probability((self.features(texts) - self.mean) / self.scale, self.weights)


def train(texts: list[str], labels: np.ndarray) -> CompressionClassifier:
    """Dictionaries from every second text, calibration on the others."""
    good, bad = ([t for t, y in zip(texts[::2], labels[::2]) if y == value] for value in (1, 0))
    # as many pieces of either class: a larger dictionary would save more on any text
    some = max(1, min(len(good), len(bad)))
    model = CompressionClassifier(dictionary(good[:some]) or b"\0" * 64, dictionary(bad[:some]) or b"\0" * 64)
    model.calibrate(texts[1::2], labels[1::2])
    return model


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and ``score`` for any model with a ``score`` of a list of texts."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return one

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, score double", make)


@query("op8_quality_compression")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    model = fitted(docs, labels, "quality", ~held, PER_CLASS, train)
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
