"""MinHash near-dedup with odd sketches.

1. A document's set is its distinct five-word shingles, as 64-bit hashes. Documents of equal sets are
   one class, for which the one with the smallest doc_id stands.
2. Each class has ``BANDS`` keys of ``ROWS`` MinHash samples, and an odd sketch: every sample
   toggles one of ``BITS`` bits. The exclusive-or of two sketches has about
   BITS / 2 * (1 - exp(-2 * d / BITS)) ones when d samples differ, so its population count tells high similarities closely.
3. Classes that share a key are compared: first each with the smallest of its bucket. Pairs
   whose sketches are near enough are confirmed on the full sets, and links give components.
4. Classes of buckets that still hold several components are compared across them, in whatever bucket: two sets that reach
   the threshold share one of their rarest shingles, so texts that have only a common passage do not meet.
   Odd sketches of the whole sets are compared first: their exclusive-or never has more ones than the sets
   have different shingles, so this drops no link. Of each class the nearest one is confirmed, last all pairs that
   are left. So a group of copies costs a link per member, and no pair is left out.

At similarity 0.75 a pair shares no key with probability (1 - 0.75**5)**32 < 0.0002; the sketch limit
lies four standard deviations below the threshold.

A class has a number of its own; doc_ids come in at the end only, so repeated ones cannot mix up texts.

Defined cases: a null text counts as empty; documents without words are linked with nothing; doc_ids are below
2**62; rows without one sort last and are told apart by their text; rows of one doc_id are one document to
``near_duplicates``, which links what their several texts are linked with; ``deduplicated`` keeps one row per group of
near texts, also where these have one doc_id; equal rows get equal rows; other columns are not read by
``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statwarden.llm.components import components
from statwarden.llm.registry import query, table
from statwarden.llm.shared import TwoGenerations, per_batch, written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS, SET_BITS = 32, 5, 512, 1024
SAMPLES = BANDS * ROWS
# Four standard deviations of the estimate, that of the samples and that of the sketch together, below the threshold.
SLACK = 0.16
MEMO_WORDS = 100_000
# rows without doc_id get numbers from here on, by their text
NO_ID = 2**62

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += mix(words[i : len(words) - width + 1 + i] * FACTORS[i])
    return np.unique(mix(total))


def samples(found: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set, piece by piece."""
    least = np.full(SAMPLES, 2**32 - 1, np.uint64)
    for a in range(0, len(found), 1024):
        values = found[None, a : a + 1024] * MULTIPLY[:, None]
        values += ADD[:, None]
        np.minimum(least, values.min(axis=1) >> np.uint64(32), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = mix(least.reshape(BANDS, ROWS) * FACTORS[None, :ROWS])
    return mix(parts.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bits toggled once by each sample; as 64-bit words."""
    places = mix(least + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    odd = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_sketch(found: np.ndarray) -> np.ndarray:
    """Bits toggled once by each shingle of a set."""
    odd = np.bincount((mix(found + FACTORS[0]) % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(percent: int = PERCENT, slack: float = SLACK) -> int:
    """The most ones in the exclusive-or of two sketches that are still compared."""
    differ = 2 * SAMPLES * (1 - (percent / 100 - slack))
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differ / BITS)))


def _word_hashes():
    memo = TwoGenerations(xxhash.xxh3_64_intdigest, MEMO_WORDS)

    def hashes(text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    return hashes


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id (a number for null), hash of the text, n_shingles, digest of the set, band keys and both sketches."""

    def make():
        hashes = _word_hashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, bands, sketches, parities = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(hashes(text))
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                least = samples(found)
                bands.append(band_keys(least) if len(found) else None)
                sketches.append(odd_sketch(least) if len(found) else None)
                parities.append(set_sketch(found) if len(found) else None)
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), *arrays], ["doc_id", "_h", "n_shingles", "digest", "bands", "sketch", "parity"])

        return one

    return per_batch(numbered(docs), "doc_id long, _h long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>", make)


def number() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID))).alias("doc_id")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(number(), F.xxhash64("text").alias("_h"), F.col("text").cast("string").alias("text"))


# what finds the text of a class
MEMBER = ("node", "digest", "doc_id", "_h")


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``node`` and its shingles for the classes ``needed`` (node, digest, doc_id and _h of a member), from their whole texts."""
    texts = numbered(docs).join(needed, ["doc_id", "_h"]).select("node", "digest", "text")

    def make():
        hashes = _word_hashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(hashes(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column("digest").to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array(same)], ["node", "shingles", "same"])

        return one

    rows = per_batch(texts, "node long, shingles array<long>, same boolean", make).where("same").drop("same")
    return rows.dropDuplicates(["node"])


def apart(field: str, bits: int) -> Column:
    """Ones in the exclusive-or of a sketch of ``of_a`` and that of ``of_b``."""
    words = [F.bit_count(F.get(F.col(f"of_a.{field}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"of_b.{field}"), F.lit(i)))) for i in range(bits // 64)]
    return reduce(lambda x, y: x + y, words)


def possible(percent: int) -> Column:
    """Whether ``of_a`` and ``of_b`` can reach the threshold, by their sizes and the sketches of their sets."""
    a, b = F.col("of_a.n_shingles"), F.col("of_b.n_shingles")
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (apart("parity", SET_BITS) * (100 + percent) <= (a + b) * (100 - percent))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach the threshold; the sets are read from the whole texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return linked(pairs, written(full_sets(docs, nodes.join(classes.select(*MEMBER), "node")), "near-sets"), percent)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")) for end in ("a", "b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return written(both.where(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b"), "near-links")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """key, node and the bucket's smallest node, for buckets of several classes."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    smallest = rows.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(smallest.drop("members"), "key")


def with_sketches(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    left, right = (facts.select(F.col("node").alias(end), F.struct("n_shingles", "sketch", "parity").alias(f"of_{end}")) for end in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(possible(percent) & (apart("sketch", BITS) <= sketch_limit(percent))).select("a", "b")


def open_classes(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes of buckets that hold several components."""
    marked = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return marked.join(several, "key").select("node").distinct()


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """The first shingles of each set, the rarest first: node, size, shingle, ``probe`` and ``index``.

    Of two sets that reach the threshold, the larger one's first size - ceil(t * size) + 1 shingles
    and the smaller one's first size - ceil(2 * t / (1 + t) * size) + 1 have one in common. What many texts share comes last.
    """
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    ordered = each.join(held, "shingle").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("order"))
    probe = F.expr(f"size - (size * {percent} + 99) div 100 + 1").cast("int")
    index = F.expr(f"size - (size * {2 * percent} + {99 + percent}) div {100 + percent} + 1").cast("int")
    first = ordered.select("node", "size", index.alias("index"), F.posexplode(F.slice("order", F.lit(1), probe)).alias("at", "s"))
    return first.select("node", "size", "s.shingle", (F.col("at") < F.col("index")).alias("index"))


def across(rare: DataFrame, labels: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a rare shingle and can reach the threshold.

    The classes of the component that holds a shingle most often meet only those of others, so
    a large group of copies and a few strays do not cost the square of the group.
    """
    known = facts.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n_shingles", "parity")
    rows = written(rare.join(known, "node"), "near-rare-rows")
    # copies of one component share their rare shingles: what all holders of one label have leads nowhere
    held = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    several = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("most")).where("labels > 1")
    rows = rows.join(several.select("shingle", "most"), "shingle").withColumn("main", F.col("label") == F.col("most"))
    side = F.struct("node", "label", "n_shingles", "parity")
    left, right = rows.select("shingle", "main", side.alias("of_a")), rows.where("index").select("shingle", F.col("main").alias("main_b"), side.alias("of_b"))
    larger = (F.col("of_a.n_shingles") > F.col("of_b.n_shingles")) | ((F.col("of_a.n_shingles") == F.col("of_b.n_shingles")) & (F.col("of_a.node") < F.col("of_b.node")))
    both = left.join(right.where("NOT main_b"), "shingle").unionByName(left.where("NOT main").join(right.where("main_b"), "shingle"))
    both = both.where((F.col("of_a.label") != F.col("of_b.label")) & larger & possible(percent))
    return both.select(F.col("of_a.node").alias("a"), F.col("of_b.node").alias("b"), apart("parity", SET_BITS).alias("distance"))


def class_labels(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id as a number, _h, n_shingles, digest) of all documents, and classes (digest, node, label): equal labels are near."""
    signed = written(signatures(docs), "near-signatures")
    first = F.first(F.struct("n_shingles", "bands", "sketch", "parity")).alias("x")  # equal for all rows of a digest
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "_h")).alias("m"), first)
    classes = written(classes.select("digest", F.monotonically_increasing_id().alias("node"), "m.*", "x.*"), "near-classes")
    facts = classes.select("node", "n_shingles", "sketch", "parity")
    buckets = written(bucket_rows(classes), "near-buckets")
    stars = buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(written(with_sketches(stars, facts, percent), "near-pairs"), docs, classes, percent)
    labels = components(links)
    # what stars left open: the nearest class of another component, then every pair that is left
    open_ = open_classes(buckets.select("key", "node"), labels).join(classes.select(*MEMBER), "node")
    sets = written(full_sets(docs, open_), "near-open-sets")
    rare = written(rare_shingles(sets, percent), "near-rare")
    for step in ("nearest", "left"):
        pairs = across(rare, labels, facts, percent)
        if step == "nearest":
            ends = pairs.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("node"))
            pairs = ends.groupBy("node").agg(F.min(F.struct("distance", "a", "b")).alias("p")).select("p.a", "p.b")
        chosen = written(pairs.select("a", "b").distinct(), f"near-{step}")
        if chosen.isEmpty():
            break
        labels = components(linked(chosen, sets, percent), labels)
    of_class = classes.select("digest", "node").join(labels, "node", "left").select("digest", "node", F.coalesce("label", "node").alias("label"))
    return signed.select("doc_id", "_h", "n_shingles", "digest"), written(of_class, "near-labels")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed, classes = class_labels(docs, percent)
    rows = written(signed.join(classes.select("digest", "label"), "digest", "left"), "near-rows")
    # a doc_id with several texts links what they are linked with
    ids = rows.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z")
    shared = rows.join(ids, "doc_id").select("a", F.col("label").alias("b")).where("b IS NOT NULL AND a <> b").distinct()
    if not ids.isEmpty():
        tops = components(shared).select(F.col("node").alias("label"), F.col("label").alias("top"))
        rows = rows.join(tops, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component"))
    found = rows.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.select(
        known("doc_id").alias("doc_id"), "n_shingles", known("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept")
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near texts: that of the smallest doc_id."""
    signed, classes = class_labels(docs, percent)
    rows = signed.join(classes.select("digest", "label"), "digest", "left")
    # a document without words is a group of its own, with its equals
    grouped = rows.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "_h")).alias("m")).select("m.*")
    alone = rows.where("label IS NULL").select("doc_id", "_h")
    kept = grouped.unionByName(alone).select(F.col("doc_id").alias("_number"), F.col("_h").alias("_text")).distinct()
    listed = docs.select(F.struct("*").alias("row"), number().alias("_number"), F.xxhash64("text").alias("_text"))
    return listed.join(kept, ["_number", "_text"], "left_semi").dropDuplicates(["_number", "_text"]).select("row.*")


@query("op10_minhash_odd_sketch")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
