"""Archives, manifests and spelling variants against plain versions."""

import gzip
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from statwarden.llm import QUERIES, merkle, variants, warc
from statwarden.llm.registry import table
from statwarden.llm.shared import folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- archives


def test_archives(spark, odd, sf_dir):
    for where in (odd[0], sf_dir):
        pages = [tuple(r) for r in table(spark, where, "pages").select("page_id", "html").collect()]
        assert rows_of(QUERIES["op11_warc_segments"](spark, where)) == sorted(brute.warc(pages), key=repr)


@pytest.mark.parametrize("segment_bytes, file_records", [(100, 3), (1 << 20, 10_000)])
def test_payloads_come_back(spark, odd, segment_bytes, file_records):
    pages = table(spark, odd[0], "pages")
    path = folder(spark, "test-warc")
    warc.write(warc.records(pages), path, segment_bytes, file_records)
    back = warc.read(spark, path).collect()
    assert all(r.complete for r in back)
    want = {(t or "").encode() for (t,) in pages.select("html").collect()}
    assert sorted(bytes(r.payload) for r in back if r.record_type == "response") == sorted(want)
    urls = {r.url for r in back if r.url}
    assert all(" " not in u and "\n" not in u for u in urls)
    if segment_bytes == 100:
        assert max(r.segments for r in back) > 900


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "abc")], "page_id long, url string, html string")
    path = folder(spark, "test-warc")
    warc.write(warc.records(pages, least_bytes=3), path)
    got = rows_of(warc.resolved(warc.read(spark, path)).select("page_id", "payload_bytes", "record_type", "refers_to", "complete"))
    small = [(i, 2, "response", None, True) for i in (1, 1, 2)]
    assert got == sorted([*small, (3, 3, "revisit", 4, True), (4, 3, "response", None, True), (None, 3, "revisit", 4, True)], key=repr)


def segmented(payload, name="<urn:x>", size=50):
    row = {"type": "response", "record_id": name, "page_id": 7, "url": None, "sha1": warc.hashlib.sha1(payload).digest(), "payload": payload, "refers_to_id": None}
    return list(warc.segments(row, size))


def read_parts(spark, tmp_path, parts, packed=gzip.compress):
    (tmp_path / "a.warc.gz").write_bytes(packed(b"".join(p + warc.END for p in parts)))
    return warc.read(spark, str(tmp_path)).collect()


def test_segments_in_any_order_and_hostile_payload(spark, tmp_path):
    payload = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n" * 40
    parts = segmented(payload) + segmented(b"other", "<urn:y>", 1000)
    random.Random(0).shuffle(parts)
    (a, b) = sorted(read_parts(spark, tmp_path, parts), key=lambda r: r.record_id)
    assert (bytes(a.payload), a.page_id, a.complete, bytes(b.payload)) == (payload, 7, True, b"other")


def test_members_and_plain_bodies(spark, tmp_path):
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nabc\r\n\r\n"
    plain = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:p>")], whole)
    extended = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:q>")], b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, chunked\r\n\r\n3;x=1\r\nabc\r\n00\r\nTrailer: 1\r\n\r\n")
    got = read_parts(spark, tmp_path, [plain, extended], lambda data: b"".join(gzip.compress(m) for m in (data[:30], data[30:])))
    assert {r.record_id: bytes(r.payload) for r in got} == {"<urn:p>": b"abc\r\n\r\n", "<urn:q>": b"abc"}


@pytest.mark.parametrize("fault", ["lost", "lost_last", "twice", "total", "digest"])
def test_faults_are_reported(spark, tmp_path, fault):
    parts = segmented(b"0123456789" * 30)
    if fault == "lost":
        del parts[2]
    elif fault == "lost_last":
        del parts[-1]
    elif fault == "twice":
        parts.append(parts[1])
    elif fault == "total":
        parts[-1] = parts[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    else:
        parts[0] = parts[0].replace(b"sha1:", b"sha1:A")
    (row,) = read_parts(spark, tmp_path, parts)
    assert (row.complete, row.payload, row.payload_bytes) == (False, None, None)


# ---------------------------------------------------------------- manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def test_manifest(spark, odd, sf_dir):
    for where in (odd[0], sf_dir):
        rows = [tuple(r) for r in table(spark, where, "documents").select(*FIELDS).collect()]
        got = rows_of(QUERIES["op12_merkle_manifest"](spark, where))
        assert got == sorted(brute.merkle(rows, third), key=repr)
        assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 65], [513, 1, 8], [4097, 600]])
def test_trees_of_all_heights(spark, sizes):
    rows = [(i, "s", f"l{g}", i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(docs, merkle.every_third())) == sorted(brute.merkle(rows, third), key=repr)


def test_many_languages(spark):
    rows = [(i, None, f"{i % 700:03}" if i else None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.manifest(docs, F.lit(True))) == sorted(brute.merkle(rows, third), key=repr)


# ---------------------------------------------------------------- variants


def test_variants(spark, odd, sf_dir):
    for where in (odd[0], sf_dir):
        rows = [tuple(r) for r in table(spark, where, "documents").select("doc_id", "text").collect()]
        want = brute.variants(rows)
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_spelling_variants"](spark, where).collect()}
        assert got == want and any(v[3] for v in want.values())


def test_many_shards_and_long_chains(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcß") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 30, 400]) for _ in range(400)}
    chain = {"q" * 7 + "r" * k: 2 * 10**k for k in range(4)}
    rows = [(i, (w + " ") * n) for i, (w, n) in enumerate({**words, **chain}.items())] + [(9999, "z" * 30_000 + " " + "z" * 30_000 + " " + "z" * 29_999 + "y " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs, shard_words=20).collect()}
    assert got == brute.variants(rows)
    assert got["q" * 7][1] == "q" * 7 + "rrr"


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def test_search_of_either_half():
    rng = random.Random(1)
    some = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    for _ in range(100):
        words = sorted({some("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 40))})
        queries = words + [some("abcd") for _ in range(5)]
        index = variants.BidirectionalIndex(words)
        got = {(q, w, side) for side in (0, 1) for q, w in zip(*(x.tolist() for x in index.near(queries, side)))}
        want = set()
        for q, a in enumerate(queries):
            half = len(a) // 2
            for w, b in enumerate(words):
                if distance_is_one(a, b):
                    want |= {(q, w, 1)} if b[:half] == a[:half] else set()
                    want |= {(q, w, 0)} if b[len(b) - len(a) + half :] == a[half:] else set()
        assert got == want


def test_rank_intervals_stay_in_step():
    index = variants.BidirectionalIndex(["banana", "bandana", "ananas"])
    text = "$banana$bandana$ananas"
    match = (np.array([0]), np.array([0]), np.array([len(text)]))
    for side, letter in ((0, "n"), (1, "a"), (0, "a"), (1, "n")):
        match = index.extend(side, match, index.codes(np.array([ord(letter)])))
    for side, pattern in ((0, "anan"), (1, "nana")):
        rotations = index.ranks[side][match[side][0] : match[side][0] + match[2][0]]
        flow = (text if side == 0 else text[::-1]) * 2
        assert len(rotations) == 2 and all(flow[i : i + 4] == pattern for i in rotations)
