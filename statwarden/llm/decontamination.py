"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words are put into one automaton. A document's words are streamed
through it: the state is the longest run of words ending here that occurs in some
item. Where that run reaches the window length (or is a whole shorter item), its
words are hit; the items are those that hold the window of the state.

The automaton is read block by block, a block having at most ``BLOCK_WORDS`` words of items,
which bounds what is broadcast; with several blocks the documents pass through one after the other, hits being
added up. Words that no item has stop every run, so only runs of known words are streamed.

Defined cases: null text or item has no words and neither hits nor is hit; items without words are skipped; a null
item_id is the empty text; repeated items count once by id; equal rows get equal rows; other columns are kept by
``decontaminated`` and not read by ``contamination``; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import per_batch, row_key, written

WINDOW = 10
BLOCK_WORDS = 100_000
# a word: bytes that are digits, letters or not ASCII; all else becomes a space, A-Z small letters
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class SuffixAutomaton:
    """All runs of words of the added sequences. State 0 is the empty run."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]

    def _state(self, longest: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """The state of exactly the runs of ``state`` followed by ``word``, parted from longer ones in ``target``."""
        if self.longest[target] == self.longest[state] + 1:
            return target
        part = self._state(self.longest[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def add(self, words: Iterable[int]) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:  # an earlier sequence has this run
                last = self._split(last, known, word)
                continue
            new = self._state(self.longest[last] + 1, {}, 0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, self.next[state][word], word)
            last = new

    def stream(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known run that ends at each word."""
        state = length = 0
        next_, link, longest = self.next, self.link, self.longest
        for word in words:
            to = next_[state].get(word)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = next_[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length


class TestItems:
    """The automaton of one block of items and what its states say of windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.automaton = SuffixAutomaton()
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items]
        for _, words in coded:
            self.automaton.add(words)
        link, longest = self.automaton.link, self.automaton.longest
        self.shortest = min((len(words) for _, words in coded), default=window)
        # windows[s]: items that have the window which s ends with; whole[s]: shorter items that are the runs of s
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in coded:
            if len(words) < window:
                *_, (state, _) = self.automaton.stream(words)
                while longest[link[state]] >= len(words):
                    state = link[state]
                self.whole.setdefault(state, []).append((len(words), item))
            for state, length in self.automaton.stream(words):
                if length >= window:
                    self.windows.setdefault(self._window_state(state), set()).add(item)
        self.has_whole = bool(self.whole)

    def _window_state(self, state: int) -> int:
        link, longest = self.automaton.link, self.automaton.longest
        while longest[link[state]] >= self.window:
            state = link[state]
        return state

    def find(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None for none) and by which items."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= min(self.shortest, self.window)
        hit, items = None, set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            for at, (state, length) in enumerate(self.automaton.stream(ids[start:end].tolist()), start + 1):
                reach = 0
                if length >= self.window:
                    items |= self.windows[self._window_state(state)]
                    reach = length
                elif self.has_whole:
                    up = state
                    while up > 0:
                        for size, item in self.whole.get(up, ()):
                            if size <= length:
                                items.add(item)
                                reach = max(reach, size)
                        up = self.automaton.link[up]
                if length >= self.window and self.has_whole:
                    up = state
                    while up > 0:
                        items |= {item for size, item in self.whole.get(up, ()) if size <= length}
                        up = self.automaton.link[up]
                if reach:
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    hit[at - reach : at] = True
        return hit, items


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``limit`` words (one item at least), read partition by partition."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row.text)
        if not words:
            continue
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id or "", words))
        size += len(words)
    if block:
        yield block


FOUND = "_id long, _h long, doc_id long, text string, hit binary, items array<string>"


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, ``hit`` (bits, one per word, null for none) and the sorted distinct ``items``."""
    spark = docs.sparkSession
    start = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    state = start.select(*row_key(), "doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    shared = None
    for block in blocks(benchmark, block_words):
        if shared is not None:
            state = written(state, "decontamination-block")
        shared = spark.sparkContext.broadcast((block, window))
        state = per_batch(state, FOUND, _matcher(shared))
    return state


def _matcher(shared):
    def make():
        # the automaton is built from the block's words once per task: the words are far smaller than it is
        items = TestItems(*shared.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits, names = [], []
            for text, hit, old in zip(*(batch.column(c).to_pylist() for c in ("text", "hit", "items"))):
                words = words_of(text)
                new, found = items.find(words)
                if new is not None:
                    before = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(words)).astype(bool) if hit else False
                    hit = np.packbits(new | before).tobytes()
                hits.append(hit)
                names.append(sorted({*old, *found}))
            keep = [batch.column(c) for c in ("_id", "_h", "doc_id", "text")]
            return pa.RecordBatch.from_arrays([*keep, pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], [f.split()[0] for f in FOUND.split(", ")])

        return one

    return make


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its words, those hit, and the items that hit it."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, text, hit, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hit", "items"))):
                n_hit = int(np.unpackbits(np.frombuffer(hit, np.uint8)).sum()) if hit else 0
                rows.append((doc_id, len(words_of(text)), n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return one

    return per_batch(matched(docs, benchmark, window, block_words), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", make)


def removed(text: str, hit: bytes | None) -> str:
    """``text`` without its runs of hit words."""
    if not hit:
        return text
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    flags = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(places))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    out, at = [], 0
    for first, last in zip(edges[::2], edges[1::2]):
        out.append(raw[at : places[first][0]])
        at = places[last - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.0, window: int = WINDOW) -> DataFrame:
    """``docs`` without those of which more than ``max_coverage`` is hit; hit spans are cut from the others."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, shares = [], []
            for text, hit in zip(batch.column("text").to_pylist(), batch.column("hit").to_pylist()):
                shares.append(float(np.unpackbits(np.frombuffer(hit, np.uint8)).sum()) / len(words_of(text)) if hit else 0.0)
                texts.append(removed(text, hit) if text is not None else None)
            return pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_h"), pa.array(shares), pa.array(texts, pa.string())], ["_id", "_h", "share", "clean"])

        return one

    found = matched(docs, benchmark, window).where("hit IS NOT NULL")
    cut = per_batch(found, "_id long, _h long, share double, clean string", make).dropDuplicates(["_id", "_h"])
    joined = docs.select(F.struct("*").alias("row"), *row_key()).join(cut, ["_id", "_h"], "left").where(F.coalesce("share", F.lit(0.0)) <= max_coverage)
    return joined.select(F.col("row").withField("text", F.coalesce("clean", "row.text")).alias("row")).select("row.*")


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
