"""Repeated substrings by a run-length index.

The Burrows-Wheeler transform of a repetitive text has few runs. The index keeps
its runs and, for both ends of each run, the text position and its common
prefix with the neighbour outside the run. Inside a run that prefix shrinks by one from one
text position to the next, so matching statistics of the whole text (the longest match
of each position anywhere else) stream out of the samples alone.

On a corpus the index is built in blocks that need nothing from each other:

1. every ``length``-byte string has an anchor, the ``GRAM``-byte string in it of least hash. Strings that are
   equal have equal anchors, so only documents' contexts (the bytes of neighbouring strings of one anchor) of an anchor
   that occurs twice can hold a repeat: counts of anchors are shuffled, not text;
2. contexts equal throughout are repeats without further work;
3. other contexts are shuffled by anchor and indexed in blocks of about ``BLOCK_BYTES``;
   the statistics tell which strings occur elsewhere;
4. an anchor with more than ``HOT_CONTEXTS`` different contexts would make a large block. Its contexts are cut by
   where the anchor lies in a string, ``WIDTHS`` places together; strings of one such cut share all but
   width - 1 bytes, whose hash takes the anchor's place, and steps 1 to 3 are run again. Strings
   of the last cut differ in two bytes, so its blocks are bounded by the alphabet.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep everything; equal rows
repeat each other and are removed whole; matches never cross documents; other columns are kept or not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.registry import query, table
from statwarden.llm.shared import per_batch, row_key, written

LENGTH = 200
GRAM = 32
BLOCK_BYTES = 256 << 10
HOT_CONTEXTS = 1000
WIDTHS = (21, 3)
# bytes that one vectorised pass takes together; longer texts are cut with overlap
PASS_BYTES = 1 << 19
POSITION_BITS = np.uint64(20)

_rng = np.random.default_rng(7151)
BYTE_VALUES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_MAX = PASS_BYTES + 2 * LENGTH + 8
POWERS = [_powers(b, _MAX) for b in BASES]
INVERSES = [_powers(pow(b, -1, 2**64), _MAX) for b in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of all substrings of some bytes by prefix sums, modulo 2**64."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        self.which, n = which, len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][raw] * POWERS[which][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * INVERSES[self.which][start] + (stop - start).astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * INVERSES[self.which][:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchored(segments: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings of one anchor in segments laid end to end.

    Gives segment, start in the segment, strings, repeats of the run right after itself, anchor hash, context hash
    and the anchor's offset from the start.
    """
    raw = np.concatenate(segments)
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    hashes = Hashes(raw)
    grams = hashes.all_of(GRAM)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.append(first, len(starts)))
    begin, seg = starts[first], owner[first]
    gram, context = grams[anchor[first]], hashes.of(begin, begin + strings + length - 1)
    # a text that repeats itself at once has the same context again and again: one row
    fresh = np.ones(len(first), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (seg[1:] != seg[:-1])
    head = np.flatnonzero(fresh)
    copies = np.diff(np.append(head, len(first)))
    seg = seg[head]
    offset = (anchor[first] - begin)[head]
    return seg, begin[head] - begins[seg], strings[head], copies, gram[head].view(np.int64), context[head].view(np.int64), offset


def segmented(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (text, offset, bytes) of about ``PASS_BYTES``; pieces of one text overlap so that no string is lost or seen twice."""
    group, size = [], 0
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, max(0, len(raw) - length + 1), PASS_BYTES):
            piece = raw[at : at + PASS_BYTES + length - 1]
            if size and size + len(piece) > PASS_BYTES:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


ROWS = "_id long, _h long, anchor long, context long, start long, strings int, copies int, offset int"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids, marks = (batch.column(c).to_numpy() for c in ("_id", "_h"))
            parts = []
            for group in segmented(texts, length):
                owner, at = np.array([g[0] for g in group]), np.array([g[1] for g in group])
                seg, start, strings, copies, anchor, context, offset = anchored([g[2] for g in group], length)
                parts.append((ids[owner[seg]], marks[owner[seg]], anchor, context, start + at[seg], *(x.astype(np.int32) for x in (strings, copies, offset))))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.int32)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in ROWS.split(", ")])

        return one

    return per_batch(docs.select(*row_key(), F.col("text").cast("string").alias("text")), ROWS, make)


class RunLengthIndex:
    """Run-length transform of some texts with samples at both ends of each run."""

    def __init__(self, texts: list[bytes]):
        # a symbol below all bytes parts the texts; no match is read beyond a text's end
        self.sizes = np.array([len(t) for t in texts])
        symbols = np.zeros(int(self.sizes.sum()) + len(texts), np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        inside = np.ones(len(symbols), bool)
        inside[self.begins + self.sizes] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.symbols = symbols.astype(np.int16)
        order = suffix_order(symbols)
        before = self.symbols[order - 1]  # the transform; a text's first position follows a separator
        # a text's first position is always a sample, so no stretch between samples crosses texts
        change = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        heads, tails = np.append(0, change), np.append(change - 1, len(order) - 1)
        self.run_symbols, self.run_lengths = before[heads], tails - heads + 1
        # samples: text position of each run end and its common prefix with the suffix beyond the run
        self.head_at, self.head_common = self._samples(order[heads], order[heads - 1], heads > 0)
        self.tail_at, self.tail_common = self._samples(order[tails], order[(tails + 1) % len(order)], tails < len(order) - 1)

    def _samples(self, at: np.ndarray, other: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = np.where(real, common_prefix(self.symbols, at, other), 0)
        by = np.argsort(at)
        return at[by], common[by]

    def statistics(self) -> np.ndarray:
        """For each position of the texts laid end to end, the longest match anywhere else, cut at its text's end."""
        here = np.arange(len(self.symbols))
        best = np.zeros(len(here), np.int64)
        for at, common in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            last = np.searchsorted(at, here, side="right") - 1
            value = np.where(last >= 0, common[np.maximum(last, 0)] - (here - at[np.maximum(last, 0)]), 0)
            np.maximum(best, value, out=best)
        ends = np.repeat(self.begins + self.sizes, self.sizes + 1)
        return np.minimum(best, ends - here)

    def repeated(self, length: int) -> list[np.ndarray]:
        """Per text: whether the string of ``length`` bytes at each start occurs anywhere else."""
        long = self.statistics() >= length
        return [long[b : b + max(0, s - length + 1)] for b, s in zip(self.begins, self.sizes)]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling from seven symbols packed into one number."""
    n = len(symbols)
    padded = np.append(symbols, np.zeros(7, np.int64))
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key << 9 | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    step = 7
    while True:
        ordered = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        step *= 2


def common_prefix(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 32) -> np.ndarray:
    """Equal symbols from both positions on, the parting symbol included in none."""
    padded = np.append(symbols, np.zeros(chunk, symbols.dtype))
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    offsets = np.arange(chunk)
    while len(live):
        x, y = a[live] + common[live], b[live] + common[live]
        inside = (x < len(symbols)) & (y < len(symbols))
        live, x, y = live[inside], x[inside], y[inside]
        left, right = padded[x[:, None] + offsets], padded[y[:, None] + offsets]
        stop = (left != right) | (left == 0)
        found = stop.any(axis=1)
        common[live] += np.where(found, stop.argmax(axis=1), chunk)
        live = live[~found]
    return common


CONTEXT = ("anchor", "start", "strings", "offset", "alone", "kinds")


def contexts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts ``wanted``, cut from the whole texts: each text is read once for all of its contexts."""
    lists = wanted.groupBy("_id", "_h").agg(F.collect_list(F.struct(*CONTEXT)).alias("list"))
    joined = docs.select(*row_key(), F.col("text").cast("string").alias("text")).join(lists, ["_id", "_h"])
    names = CONTEXT

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("list")
            each = np.diff(lists.offsets.to_numpy())
            flat = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, lists.flatten().flatten())}
            owner = np.repeat(np.arange(len(each)), each)
            raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found = [raws[o][s : s + k + length - 1] for o, s, k in zip(owner.tolist(), flat["start"].tolist(), flat["strings"].tolist())]
            ids, marks = (batch.column(c).to_numpy()[owner] for c in ("_id", "_h"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, marks, *flat.values())] + [pa.array(found, pa.binary())], ["_id", "_h", *names, "bytes"])

        return one

    return per_batch(joined, "_id long, _h long, anchor long, start long, strings int, offset int, alone boolean, kinds long, bytes binary", make)


SPANS = "_id long, _h long, span long"


def _spans(ids, marks, starts, flags, length: int) -> pa.RecordBatch:
    """Runs of flagged starts as spans, ``begin << 32 | end``."""
    owner = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
    at = np.concatenate([np.arange(len(f)) for f in flags]) if flags else np.zeros(0, np.int64)
    on = np.flatnonzero(np.concatenate(flags)) if flags else np.zeros(0, np.int64)
    owner, at = owner[on], at[on]
    new = np.ones(len(on), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(on) - 1) if len(first) else first
    who = owner[first]
    begin, end = starts[who] + at[first], starts[who] + at[last] + length
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(marks[who]), pa.array(begin << 32 | end)], ["_id", "_h", "span"])


def indexed(contexts: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Spans of repeats by run-length indexes of blocks of whole anchors."""
    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids, marks, starts, alone, texts = zip(*[(h[0], h[1], h[3], h[4], h[5]) for h in held])
            flags = RunLengthIndex(list(texts)).repeated(length)
            mine = np.flatnonzero(alone)  # contexts with equal ones are removed already
            take = lambda x: np.array(x, np.int64)[mine]
            return _spans(take(ids), take(marks), take(starts), [flags[i] for i in mine], length)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_id", "_h", "anchor", "start", "alone", "bytes"))):
                if held and size >= block_bytes and row[2] != held[-1][2]:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield close()

    return ordered.select("_id", "_h", "anchor", "start", "alone", "bytes").mapInArrow(run, SPANS)


CUT_ROWS = f"{ROWS}, bytes binary"


def cut(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Rows like those of ``anchor_rows``, with their bytes: contexts cut by the place of their anchor in a string.

    The strings of a cut have their anchor at ``width`` neighbouring places and
    share ``length - width + 1`` bytes around it, wherever they occur; the hash of these is the new anchor.
    """

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            names = ("_id", "_h", "start", "strings", "offset", "alone", "bytes")
            for id_, mark, start, strings, offset, alone, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                # the anchor is at place offset - s of string s
                first = np.arange(offset // width, (offset - strings + 1) // width - 1, -1)
                low = np.maximum(0, offset - (first + 1) * width + 1)
                high = np.minimum(strings - 1, offset - first * width)
                shared = offset - first * width
                raw = np.frombuffer(raw, np.uint8)
                a, b = Hashes(raw, 0), Hashes(raw, 1)
                keys = a.of(shared, shared + length - width + 1) + first.astype(np.uint64) * np.uint64(BASES[0])
                whole = b.of(low, high + length)
                for cells in zip(keys.view(np.int64).tolist(), whole.view(np.int64).tolist(), low.tolist(), high.tolist()):
                    out.append((id_, mark, cells[0], cells[1], start + cells[2], cells[3] - cells[2] + 1, 1 if alone else 2, offset - cells[2], raw[cells[2] : cells[3] + length].tobytes()))
            types = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in CUT_ROWS.split(", ")])

        return one

    return per_batch(contexts.select("_id", "_h", "start", "strings", "offset", "alone", "bytes"), CUT_ROWS, make)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, hot_contexts: int = HOT_CONTEXTS, block_bytes: int = BLOCK_BYTES, widths: tuple[int, ...] = WIDTHS
) -> DataFrame:
    """``_id``, ``_h``, ``span``: byte ranges covered by strings of ``length`` bytes that also start elsewhere."""
    rows, spans = anchor_rows(docs, length), []
    for width in (*widths, None):
        bytes_ = ["bytes"] if spans else []  # cuts have theirs, documents are not read again
        several = rows.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
        rows = written(rows.join(several, "anchor"), "repeat-anchors")
        contexts = rows.groupBy("anchor", "context").agg(F.sum("copies").alias("n"), F.min(F.struct("_id", "_h", "start", "strings", "offset", *bytes_)).alias("one"))
        contexts = written(contexts, "repeat-contexts")
        # contexts that occur twice are repeats throughout
        twice = contexts.where("n > 1").select("anchor", "context")
        end = F.col("start") + F.col("strings") * F.col("copies") - 1 + length
        if spans:  # a cut that stands for equal contexts is counted twice, but lies in one place
            end = F.col("start") + F.col("strings") - 1 + length
        spans.append(rows.join(twice, ["anchor", "context"]).select("_id", "_h", F.shiftleft("start", 32).bitwiseOR(end.cast("long")).alias("span")))
        # the others need their bytes, and one of each kind as what they may match
        kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        wanted = contexts.join(kinds, "anchor").select("one.*", "anchor", (F.col("n") == 1).alias("alone"), "kinds")
        found = written(wanted if bytes_ else contexts_of(docs, wanted, length), "repeat-bytes")
        is_hot = F.col("kinds") > (hot_contexts if width else 2**62)
        spans.append(indexed(found.where(~is_hot), length, block_bytes))
        hot = found.where(is_hot)
        if not width or hot.isEmpty():
            break
        rows = cut(hot, length, width)
    return reduce(DataFrame.unionByName, spans)


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint (begin, end) rows, those that touch joined."""
    pairs = np.column_stack([spans >> 32, spans & 0xFFFFFFFF])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([pairs[first, 0], reach[np.append(first[1:] - 1, len(pairs) - 1)]])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per document: its sizes, the digest of the bytes kept and those bytes (which may cut a character)."""
    spans = repeated_spans(docs, length, **options).groupBy("_id", "_h").agg(F.collect_list("span").alias("spans"))
    joined = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, ["_id", "_h"], "left")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = (text or "").encode()
                kept, cut = raw, np.zeros((0, 2), np.int64)
                if spans:
                    cut = merged(np.array(spans, np.int64))
                    kept = b"".join(raw[a:b] for a, b in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(raw)]))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in OUT.split(", ")])

        return one

    return per_batch(joined.select("doc_id", "text", "spans"), OUT, make)


@query("op1_run_length_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
