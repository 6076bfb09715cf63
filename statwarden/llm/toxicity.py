"""Toxic spans by a linear-chain conditional random field, and document scores.

Labels are given per document, so tokens of the training texts are labelled
first: a word or word beginning is toxic if toxic training texts hold it in many distinct
surroundings (copies of a text add none) and clean ones hold it hardly ever. On these labelled tokens a chain of two
states is fitted by the forward-backward algorithm; other training texts then calibrate the document score, a
function of the highest marginal, the toxic tokens expected and their share. Marginals of at least
one half are the reported spans.

A token's evidence depends on the word alone and is memoised per worker; the
recursions run over all pieces of a batch's documents at once.

Training reads at most ``PER_CLASS`` texts of each class; every document is tagged over its whole text.

Defined cases: null text counts as empty; a text without words gets the calibrated score of no toxic token;
equal rows get equal rows; without labels of both classes the score is constant and low, unless all labels are toxic; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.labelled import fitted, fold, logistic, probability
from statwarden.llm.registry import query, table
from statwarden.llm.shared import TwoGenerations, per_batch

PER_CLASS = 1500
BUCKETS = 1 << 18
PIECE = 128
MEMO_WORDS = 200_000
# a word or beginning is toxic with so many surroundings in toxic texts, and this many times its rate in clean ones
SURROUNDINGS, TIMES = 10, 20.0
WORD = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    low = word.lower()
    return [f"w:{low}", *(f"{k}:{low[:k]}" for k in (4, 5, 6) if len(low) > k)]


def features(word: str) -> list[int]:
    """Hashed traits of a word: itself, beginnings, endings and case."""
    low = word.lower()
    shape = "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    traits = [*beginnings(word), f"e:{low[-3:]}", f"3:{low[:3]}", f"s:{shape}", "1"]
    return [zlib.crc32(t.encode()) % BUCKETS for t in traits]


def surroundings(texts: list[list[str]]) -> dict[int, int]:
    """Distinct neighbourhoods of each word and beginning, by its hash; as arrays, which need little memory."""
    traits, places = array("q"), array("q")
    for words in texts:
        for i, word in enumerate(words):
            around = words[i - 1] if i else "", word, words[i + 1] if i + 1 < len(words) else ""
            for trait in beginnings(word):
                traits.append(hash(trait))
                places.append(hash((trait, around)))
    _, first = np.unique(np.frombuffer(places, np.int64), return_index=True)
    found, counts = np.unique(np.frombuffer(traits, np.int64)[first], return_counts=True)
    often = counts >= 2  # a single surrounding weighs next to nothing
    return dict(zip(found[often].tolist(), counts[often].tolist()))


def toxic_traits(texts: list[list[str]], labels: np.ndarray) -> set[int]:
    """Hashes of words and beginnings that mark toxic texts, by distinct surroundings."""
    clean, toxic = ([words for words, y in zip(texts, labels) if y == label] for label in (0, 1))
    share = sum(map(len, toxic)) / max(1, sum(map(len, clean)))
    many = {t: n for t, n in surroundings(toxic).items() if n >= SURROUNDINGS}
    among = surroundings(clean)
    return {t for t, n in many.items() if n >= TIMES * share * (among.get(t, 0) + 0.2)}


def chain_pieces(weights: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The normalised recursion v[t] = (v[t-1] @ move) * (1, weight[t]) over documents laid end to end; gives v[t][1].

    Each document is cut into pieces that run side by side. The map of a piece
    is a 2x2 matrix; one pass finds the matrices, a short one over a document's
    pieces the vector each begins with, the last pass the tokens.
    """
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + number * PIECE
    size = np.minimum(PIECE, lengths[owner] - number * PIECE)
    steps = np.arange(PIECE)[:, None]
    known = steps < size
    at = start + steps
    weight = np.where(known, weights[np.minimum(at, len(weights) - 1)], 1.0)
    (t00, t01), (t10, t11) = move
    first = np.tile(begin, (len(owner), 1))
    inner = np.flatnonzero(number[1:] > 0)  # pieces with one after them
    if len(inner):
        # rows of the map: state before the first token; columns: state before the next piece
        m00, m01, m10, m11 = (np.full(len(inner), v) for v in (1.0, 0.0, 0.0, 1.0))
        for w in weight[:, inner]:
            m01, m11 = m01 * w, m11 * w
            m00, m01, m10, m11 = m00 * t00 + m01 * t10, m00 * t01 + m01 * t11, m10 * t00 + m11 * t10, m10 * t01 + m11 * t11
            total = m00 + m01 + m10 + m11
            m00, m01, m10, m11 = m00 / total, m01 / total, m10 / total, m11 / total
        order = np.argsort(number[inner], kind="stable")
        bounds = np.searchsorted(number[inner][order], np.arange(number.max() + 1))
        for low, high in zip(bounds, bounds[1:]):
            now = order[low:high]
            v0, v1 = first[inner[now]].T
            a, b = v0 * m00[now] + v1 * m10[now], v0 * m01[now] + v1 * m11[now]
            first[inner[now] + 1] = np.column_stack([a / (a + b), b / (a + b)])
    out = np.empty(len(weights))
    a, b = first[:, 0], first[:, 1]
    result = np.empty_like(weight)
    for t, w in enumerate(weight):
        b = b * w
        total = a + b
        a, b = a / total, b / total
        result[t] = b
        a, b = a * t00 + b * t10, a * t01 + b * t11
    out[at[known]] = result[known]
    return out


class ChainField:
    """Two states, clean and toxic; a token's odds come from the features of its word."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS, np.float32)
        self.move = np.log(np.array([[0.99, 0.01], [0.9, 0.1]]))
        self.begin = np.log(np.array([0.99, 0.01]))
        self.doc_weights = np.zeros(4)

    def evidence_of(self) -> Callable[[str], float]:
        """The log-odds of a word, over plain lists: a worker meets many new words, each once."""
        weights = self.weights.tolist()
        return lambda word: min(18.0, max(-18.0, sum(weights[i] for i in features(word))))

    def marginals(self, evidence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state at each token, from the forward and the backward recursion."""
        odds, move, begin = np.exp(evidence), np.exp(self.move), np.exp(self.begin)
        forward = chain_pieces(odds, lengths, move, begin)
        # the same recursion on the reversed text gives the backward part with the token's own evidence
        backward = chain_pieces(odds[::-1], lengths[::-1], move.T, np.ones(2))[::-1]
        toxic = forward * backward / odds
        clean = (1 - forward) * (1 - backward)
        return toxic / np.maximum(toxic + clean, 1e-300)

    def fit(self, texts: list[list[str]], labelled: list[np.ndarray], rounds: int = 25, rate: float = 0.5, decay: float = 1e-6) -> None:
        """Adagrad on the log-likelihood; the expected counts are the marginals."""
        if not texts:
            return
        lengths = np.array([len(t) for t in texts])
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        words = np.array([vocabulary[w] for t in texts for w in t])
        truth = np.concatenate(labelled).astype(float)
        listed, sizes = array("q"), array("q")
        for word in vocabulary:
            found = features(word)
            listed.extend(found)
            sizes.append(len(found))
        flat, owner, n = np.frombuffer(listed, np.int64), np.repeat(np.arange(len(sizes)), np.frombuffer(sizes, np.int64)), len(sizes)
        weights, history = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
        last = np.cumsum(lengths) - 1
        inner = np.ones(len(words), bool)
        inner[last] = False
        pair = truth[:-1][inner[:-1]] * 2 + truth[1:][inner[:-1]]
        counts = np.bincount(pair.astype(int), minlength=4).reshape(2, 2) + 1.0
        self.move = np.log(counts / counts.sum(axis=1, keepdims=True))
        opening = truth[last - lengths + 1]
        self.begin = np.log(np.array([(opening == 0).sum() + 1.0, opening.sum() + 1.0]) / (len(opening) + 2))
        for _ in range(rounds):
            per_word = np.clip(np.bincount(owner, weights[flat], n), -18, 18)
            marginal = self.marginals(per_word[words], lengths)
            slope = np.bincount(words, truth - marginal, n)
            step = np.bincount(flat, slope[owner], BUCKETS) - decay * len(words) * weights
            history += step**2
            weights += rate * step / np.sqrt(history)
        self.weights = weights.astype(np.float32)

    def tag(self, texts: list[list[str]], memo) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        some = lengths > 0
        out = [np.zeros(0)] * len(texts)
        if some.any():
            evidence = np.fromiter((memo[w] for t in texts for w in t), np.float64, int(lengths.sum()))
            parts = np.split(self.marginals(evidence, lengths[some]), np.cumsum(lengths[some])[:-1])
            for i, part in zip(np.flatnonzero(some), parts):
                out[i] = part
        return out

    def document_features(self, tagged: list[np.ndarray]) -> np.ndarray:
        rows = []
        for p in tagged:
            top, sure = (float(p.max()), float(p[p >= 0.5].sum())) if len(p) else (0.0, 0.0)
            rows.append((np.log((top + 1e-4) / (1 - top + 1e-4)) / 4, np.log1p(sure), 10 * sure / (len(p) + 10)))
        return np.array(rows).reshape(-1, 3)

    def score(self, tagged: list[np.ndarray]) -> np.ndarray:
        return probability(self.document_features(tagged), self.doc_weights)


def train(texts: list[str], labels: np.ndarray) -> ChainField:
    """Three of four texts label tokens and fit the chain, the fourth calibrates the document score."""
    split = [WORD.findall(t) for t in texts]
    fitting = np.arange(len(texts)) % 4 != 3
    first = [w for w, f in zip(split, fitting) if f]
    marks = toxic_traits(first, labels[fitting]) if len(texts) else set()
    labelled = [np.array([bool(y) and any(hash(b) in marks for b in beginnings(w)) for w in words], bool) for words, y in zip(first, labels[fitting])]
    model = ChainField()
    kept = [i for i, words in enumerate(first) if words]
    model.fit([first[i] for i in kept], [labelled[i] for i in kept])
    if len(set(labels.tolist())) < 2:  # nothing tells toxic texts: none is, unless all labels say so
        model.doc_weights[-1] = 4.0 if len(labels) and labels[0] else -4.0
        return model
    other = ~fitting if len(set(labels[~fitting].tolist())) == 2 else np.ones(len(texts), bool)  # few labels serve twice
    tagged = model.tag([w for w, o in zip(split, other) if o], TwoGenerations(model.evidence_of(), MEMO_WORDS))
    model.doc_weights = logistic(model.document_features(tagged), labels[other], ridge=0.1)
    return model


SCORED = "doc_id long, score double, n_toxic long, spans string"


def scored(docs: DataFrame, model: ChainField) -> DataFrame:
    """doc_id, score, number of toxic tokens and ``spans``: start:end of each run of them, code points, comma-joined."""

    def make():
        memo = TwoGenerations(model.evidence_of(), MEMO_WORDS)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tagged = model.tag([WORD.findall(t) for t in texts], memo)
            spans = [",".join(offsets(t, p)) if len(p) and p.max() >= 0.5 else "" for t, p in zip(texts, tagged)]
            counts = [int((p >= 0.5).sum()) for p in tagged]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(tagged)), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], ["doc_id", "score", "n_toxic", "spans"])

        return one

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), SCORED, make)


def accepted(docs: DataFrame, model: ChainField, limit: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches ``limit``; all columns are kept as they are."""

    def make():
        memo = TwoGenerations(model.evidence_of(), MEMO_WORDS)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score(model.tag([WORD.findall(t or "") for t in batch.column("text").to_pylist()], memo))
            return batch.filter(pa.array(scores < limit))

        return one

    return per_batch(docs, docs.schema, make)


def offsets(text: str, marginal: np.ndarray) -> Iterator[str]:
    """Runs of toxic tokens as start:end."""
    start = end = None
    for match, p in zip(WORD.finditer(text), marginal):
        if p >= 0.5:
            start, end = (match.start() if start is None else start), match.end()
        elif start is not None:
            yield f"{start}:{end}"
            start = None
    if start is not None:
        yield f"{start}:{end}"


def trained(docs: DataFrame, labels: DataFrame) -> ChainField:
    """The model of the training fold."""
    return fitted(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, PER_CLASS, train)


@query("op6_toxicity_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 5) == 0
    rows = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")
