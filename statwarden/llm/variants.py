"""Spelling variants: words one edit apart, found in bidirectional FM-indexes.

The vocabulary is cut into shards by code-point order, once of the words and once of
the reversed words. Each shard is the delimited text ``$word$word...`` with the
Burrows-Wheeler transform of itself and of its reverse, whose suffix-rank intervals
are kept in step, so that a match can grow to either side. A word looks for its
neighbours by two searches: its first half is matched exactly and extended to the
right with one error, and its second half exactly and extended to the left with one
error. One edit leaves one half whole, so no neighbour is missed; what both searches
find is counted by the first.

A search goes to every shard that can hold a word with that half, known from the
shards' bounds: at most ``MAX_SHARDS`` texts of at most ``BOUND_CHARS`` code points.

Defined cases: null texts have no words; a null doc_id is the empty text in the hash
of a run; each row of a repeated document counts; runs of any length are words; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_ROWS, FORM_FACTOR, TYPO = 7, 2, 10, 31
# Words of a shard. Beyond 65,536 shards (500 million words) shards grow instead.
SHARD_WORDS, MAX_SHARDS, BOUND_CHARS, SAMPLES = 8192, 1 << 16, 40, 8
# Entries of a task's counter before it is handed on, and words searched at once.
COUNTER_ENTRIES, QUERIES_AT_ONCE = 200_000, 2048
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ---------------------------------------------------------------- vocabulary


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_rows: int = LEAST_ROWS, typo: int = TYPO) -> DataFrame:
    """(word, n): every run of letters, lower-cased in A-Z; one in ``typo`` by hash loses a code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of fewer letters cannot give a word, and no part of it matches either
        run = re.compile(f"[{LETTERS}]{{{least_length},}}")
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                start = f"{'' if doc_id is None else doc_id}:".encode()
                base = crc32(start)
                for word, n in Counter(run.findall((text or "").translate(LOWER))).items():
                    h = crc32(word.encode(), base)
                    if h % typo == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) >= COUNTER_ENTRIES:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows)


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


# ---------------------------------------------------------------- index


class BidirectionalIndex:
    """FM-indexes of the cyclic text ``$word$word...`` (0) and of its reverse (1).

    A match is (rank in index 0, rank in index 1, size); side 0 extends it to the
    left, side 1 to the right. Distinct words make all rotations distinct.
    """

    def __init__(self, words: list[str]):
        points = np.array(list("$" + "$".join(words)), "U1").view(np.uint32)
        letters = np.unique(points)
        # the delimiter is below all letters
        self.letters = np.concatenate([[ord("$")], letters[letters != ord("$")]]).astype(np.uint32)
        text = self.codes(points)
        self.size = len(text)
        self.word_at = np.cumsum(text == 0) - 1
        self.ranks, self.less, self.before = [], [], []
        for direction in (text, text[::-1]):
            order = rotations(direction, len(self.letters))
            before = direction[order - 1]
            less = np.zeros((len(self.letters) + 1, self.size + 1), np.int32)
            np.cumsum(before[None, :] < np.arange(len(self.letters) + 1, dtype=before.dtype)[:, None], axis=1, out=less[:, 1:])
            self.less.append(less)
            self.before.append(before)
            self.ranks.append(order)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Number of each letter, -1 for one that no word has."""
        by_point = np.argsort(self.letters)
        at = np.minimum(np.searchsorted(self.letters[by_point], points), len(self.letters) - 1)
        found = by_point[at]
        return np.where(self.letters[found] == points, found, -1).astype(np.int16)

    def extend(self, side: int, match: tuple, letter: np.ndarray) -> tuple:
        """The matches grown by one letter each; a size of 0 is no match."""
        less, (own, other) = self.less[side], (match[side], match[1 - side])
        end = own + match[2]
        below, below_end = less[letter, own], less[letter, end]
        rank = less[letter + 1, own] - below
        size = less[letter + 1, end] - below_end - rank
        own, other = less[letter, self.size] + rank, other + below_end - below
        return (own, other, size) if side == 0 else (other, own, size)

    def children(self, side: int, match: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which match can grow by which letter, delimiter left out."""
        own, size, sigma = match[side], match[2], len(self.letters)
        wide = np.flatnonzero(size > sigma)
        less = self.less[side]
        counts = np.diff(less[:, own[wide] + size[wide]] - less[:, own[wide]], axis=0)
        letter, which = np.nonzero(counts[1:])
        narrow = np.flatnonzero(size <= sigma)
        many = size[narrow]
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(own[narrow], many)
        before = self.before[side][rows]
        pairs = np.unique(np.repeat(narrow, many)[before > 0] * sigma + before[before > 0])
        return np.concatenate([wide[which], pairs // sigma]), np.concatenate([letter + 1, pairs % sigma])

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart that share the query's first half (side 1) or second half (side 0)."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.zeros((len(words), lengths.max() + 1), np.int16)
        flat = self.codes(np.array(list("".join(words)), "U1").view(np.uint32))
        columns = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = np.repeat(np.arange(len(words)), lengths)
        if side == 0:
            columns = np.repeat(lengths, lengths) - 1 - columns
        points[rows, columns] = flat
        first = lengths // 2
        half = first if side == 1 else lengths - first
        # the exact half, from its inner end out to the delimiter
        query = np.arange(len(words))
        match = (np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64))
        for step in range(int(half.max()) + 1):
            at = half[query] - 1 - step
            open_ = at >= -1
            letter = np.where(at >= 0, points[query, np.maximum(at, 0)], 0)
            grown = self.extend(1 - side, match, np.maximum(letter, 0))
            grown = tuple(np.where(open_, g, m) for g, m in zip(grown, match))
            alive = (grown[2] > 0) & ~(open_ & (letter < 0))
            query, match = query[alive], tuple(g[alive] for g in grown)
        found_query, found_word = [], []
        place = half[query]
        one = (np.zeros(0, np.int64),) * 2, (np.zeros(0, np.int64),) * 3  # (query, place), match with one error
        while len(query) or len(one[0][0]):
            end = lengths[query]
            inner = place < end
            wanted = np.where(inner, points[query, place], 0)
            which, letter = self.children(side, match)
            child = self.extend(side, tuple(m[which] for m in match), letter)
            same = inner[which] & (letter == wanted[which])
            replaced = inner[which] & ~same
            new = (
                (query[which], place[which], child),  # inserted
                (query[which][replaced], place[which][replaced] + 1, tuple(m[replaced] for m in child)),
                (query[inner], place[inner] + 1, tuple(m[inner] for m in match)),  # deleted
            )
            q1 = np.concatenate([one[0][0], *(x[0] for x in new)])
            p1 = np.concatenate([one[0][1], *(x[1] for x in new)])
            m1 = tuple(np.concatenate([one[1][i], *(x[2][i] for x in new)]) for i in range(3))
            # those with their error go on exactly; the delimiter ends a word
            letter = points[q1, p1]
            grown = self.extend(side, m1, np.maximum(letter, 0))
            alive = (grown[2] > 0) & (letter >= 0)
            q1, p1, m1 = q1[alive], p1[alive], tuple(g[alive] for g in grown)
            done = p1 == lengths[q1]
            found_query.append(q1[done])
            # a whole match is "$word$" and occurs once; its rank in index 0 tells where it begins
            found_word.append(self.word_at[self.ranks[0][m1[0][done]]])
            one = (q1[~done], p1[~done] + 1), tuple(m[~done] for m in m1)
            query, place, match = query[which][same], place[which][same] + 1, tuple(m[same] for m in child)
        pairs = np.unique(np.concatenate(found_query) * len(self.word_at) + np.concatenate(found_word))
        return pairs // len(self.word_at), pairs % len(self.word_at)


def rotations(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the rotations of a cyclic text in sorted order, by doubling from packed letters."""
    size, bits = len(text), max(int(sigma - 1).bit_length(), 1)
    known = max(1, 62 // bits)
    rank = np.zeros(size, np.int64)
    for k in range(known):
        rank = (rank << bits) | np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == size - 1 or known >= size:
            return order
        rank = rank * size + np.roll(rank, -known)
        known *= 2


# ---------------------------------------------------------------- search over shards


def bounds(words: DataFrame, order, total: int, shard_words: int = SHARD_WORDS) -> list[str]:
    """Sorted texts that part the words into shards of about ``shard_words``; sampled by hash, so a rerun gives the same."""
    shards = min(-(-total // shard_words), MAX_SHARDS)
    if shards <= 1:
        return []
    key = F.left(order, F.lit(BOUND_CHARS))
    some = words.where(F.pmod(F.xxhash64("word"), F.lit(total)) < shards * SAMPLES).select(key.alias("bound"))
    return sorted(some.toArrow().column("bound").to_pylist())[SAMPLES::SAMPLES]


def routed(words: DataFrame, total: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """Each word as a member (``is_query`` false) of one shard of either order, and as a query to those that can hold its halves."""
    forward, backward = bounds(words, F.col("word"), total, shard_words), bounds(words, F.reverse("word"), total, shard_words)
    parts = len(forward) + 1

    def shards(parting: list[str], half: str) -> range:
        half = half[:BOUND_CHARS]
        return range(bisect_right(parting, half), bisect_right(parting, half + chr(0x10FFFF)) + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                half = len(word) // 2
                for parting, base, text, known in ((forward, 0, word, word[:half]), (backward, parts, word[::-1], word[half:][::-1])):
                    rows.append((base + bisect_right(parting, text[:BOUND_CHARS]), False, word, n))
                    rows += [(base + s, True, word, n) for s in shards(parting, known)]
            types = (pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "is_query", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "shard int, is_query boolean, word string, n long"), parts


def neighbours(words: DataFrame, total: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, best) per word: how many words are one edit apart, and of these the most frequent as (-n, word)."""
    rows, parts = routed(words, total, shard_words)
    spread = rows.repartition(max(2, min(4 * parts, MAX_SHARDS)), "shard").sortWithinPartitions("shard", "is_query", "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, counts, index, queries = None, [], [], None, []

        def answer():
            nonlocal index
            if members:
                index = index or BidirectionalIndex(members)
                ns = np.array(counts)
                for some in batched(queries):
                    yield _answered(index, members, ns, some, 1 if shard < parts else 0)
            elif queries:
                yield _answered(None, [], np.zeros(0, np.int64), queries, 1)

        for batch in batches:
            for row_shard, is_query, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if row_shard != shard:
                    yield from answer()
                    shard, members, counts, index, queries = row_shard, [], [], None, []
                if not is_query:
                    members.append(word)
                    counts.append(n)
                    continue
                queries.append((word, n))
                if len(queries) >= 4 * QUERIES_AT_ONCE:
                    yield from answer()
                    queries = []
        yield from answer()

    found = spread.mapInArrow(search, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))


def batched(queries: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """Queries of like length together: a batch is a matrix of letters of bounded size."""
    some: list[tuple[str, int]] = []
    for row in sorted(queries, key=lambda q: len(q[0])):
        if some and (len(some) >= QUERIES_AT_ONCE or (len(some) + 1) * len(row[0]) > 64 * QUERIES_AT_ONCE):
            yield some
            some = []
        some.append(row)
    if some:
        yield some


def _answered(index: BidirectionalIndex | None, members: list[str], counts: np.ndarray, queries: list[tuple[str, int]], side: int) -> pa.RecordBatch:
    words = [w for w, _ in queries]
    near, best = np.zeros(len(words), np.int64), [None] * len(words)
    if index is not None:
        query, found = index.near(words, side)
        if side == 0:
            # neighbours that share the first half too are the other search's
            only = np.array([members[f][: len(words[q]) // 2] != words[q][: len(words[q]) // 2] for q, f in zip(query.tolist(), found.tolist())], bool)
            query, found = query[only], found[only]
        near = np.bincount(query, minlength=len(words))
        # members are sorted by word: the first of the largest n is the least word
        order = np.lexsort((found, -counts[found], query))
        query, found = query[order], found[order]
        for at in np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else ():
            best[query[at]] = found[at]
    best_n = [None if b is None else int(counts[b]) for b in best]
    columns = [words, [n for _, n in queries], near, best_n, [None if b is None else members[b] for b in best]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "n_near", "best_n", "best"]
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): where following forms ends, by doubling. A form has more rows than its word, so there is no circle."""
    reached = written(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if reached.join(further, "root", "left_semi").isEmpty():
            return reached
        reached = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def variants(docs: DataFrame, factor: int = FORM_FACTOR, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """One row per word: its neighbours, its form and the root of its forms (see the contract of the query)."""
    words = written(vocabulary(docs, **options), "vocabulary")
    near = neighbours(words, words.count(), shard_words)
    best_n, form = -F.col("best.minus_n"), F.col("best.word")
    is_form = F.coalesce(best_n >= factor * F.col("n"), F.lit(False))
    known = written(
        near.select("word", "n", F.when(is_form, form).alias("form"), F.when(is_form, best_n).alias("form_n"), "n_near"), "variants"
    )
    reached = roots(known.where("form IS NOT NULL"))
    return known.join(reached, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
