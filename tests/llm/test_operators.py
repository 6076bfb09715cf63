"""Each query on the odd tables and on the given ones, against plain versions and the libraries."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statwarden.llm import QUERIES, curriculum, decontamination, exact_dedup, minhash_odd, quality, run_index, secrets, shared, token_counts, token_output, toxicity
from statwarden.llm.components import components
from statwarden.llm.registry import table

KEY = lambda row: tuple((x is None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def given(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_empty_tables(spark, empty, key):
    assert QUERIES[key](spark, empty).count() == 0


def test_repeats(spark, odd, sf_dir):
    folder, rows = odd
    assert rows_of(QUERIES["op1_run_length_dedup"](spark, folder)) == sorted(brute.repeats(rows), key=repr)
    some = given(spark, sf_dir)
    assert rows_of(QUERIES["op1_run_length_dedup"](spark, sf_dir)) == sorted(brute.repeats(some), key=repr)


def test_repeats_with_every_anchor_hot_and_small_blocks(spark, odd):
    folder, rows = odd
    docs = table(spark, folder, "documents")
    got = run_index.without_repeats(docs, hot_contexts=1).drop("kept")
    assert rows_of(got) == sorted(brute.repeats(rows), key=repr)
    assert rows_of(run_index.without_repeats(docs, block_bytes=1).drop("kept")) == sorted(brute.repeats(rows), key=repr)


def test_run_length_index():
    rng = random.Random(1)
    for _ in range(100):
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        if not any(texts):
            continue
        size = rng.randint(1, 6)
        index = run_index.RunLengthIndex(texts)
        strings = [t[i : i + size] for t in texts for i in range(len(t) - size + 1)]
        assert [[bool(x) for x in f] for f in index.repeated(size)] == [[strings.count(t[i : i + size]) > 1 for i in range(len(t) - size + 1)] for t in texts]
        assert int(index.run_lengths.sum()) == sum(map(len, texts)) + len(texts)


def test_secrets(spark, odd):
    folder, rows = odd
    got = rows_of(QUERIES["op2_secret_linking"](spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"))
    assert got == sorted(((i, *brute.base_secrets(t or "")) for i, t in rows), key=repr)


def test_weak_parts_need_both_others(spark):
    texts = ["user=bob token: abc https://x.org", "user=bob token: abc", "token: abc https://x.org", "user=bob token: abc" + " " * 300 + "https://x.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert spans == {0: "identifier:0:8,weak:9:19,endpoint:20:33", 1: "", 2: "", 3: ""}


def test_curriculum(spark, odd):
    folder, rows = odd
    got = QUERIES["op3_mixing_curriculum"](spark, folder).collect()
    docs = table(spark, folder, "documents").collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(brute.NOT_BLANK.findall(d.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = brute.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    by_size = {sizes[n]: w for n, w in zip(names, want)}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
    assert {s: int(t) for s, t in by_size.items()} == dict(taken)
    places = [r.position_1 for r in got if r.position_1 is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)


def test_targets_by_rounds(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = [rng.choice([1, 5, 50, 4000, 10**6]) for _ in range(rng.randint(1, 7))]
        rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r.target for r in curriculum.targets(rows).orderBy("source").collect()]
        assert got == pytest.approx(brute.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_small_ranges_change_nothing(spark, odd):
    folder, _ = odd
    docs = table(spark, folder, "documents")
    assert rows_of(curriculum.curriculum(docs, range_rows=2)) == rows_of(curriculum.curriculum(docs))


def test_mix_tells_equal_rows_apart_by_their_other_columns(spark):
    """Rows equal in id, source and text take different parts; which one does not depend on the tasks."""
    rows = [(1, "b", "w1 w2 w3 w4 w5", n, {"k": n}, [n % 3]) for n in range(9)] + [(2, "a", "x " * 40, 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars int, extra map<string,int>, parts array<int>")
    seen = [sorted(map(str, curriculum.mixed(docs.repartition(k, "n_chars")).collect())) for k in (1, 3, 7)]
    assert seen[0] == seen[1] == seen[2]
    parts = [r.text for r in curriculum.mixed(docs).where("source = 'b'").collect()]
    assert len(set(parts)) > 1  # some row is cut, and it is the same one each time


def test_mix_has_the_words_taken(spark, odd):
    folder, _ = odd
    docs = table(spark, folder, "documents")
    mix = curriculum.mixed(docs)
    assert mix.schema == docs.schema
    words = lambda c: F.sum(F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))
    taken = curriculum.curriculum(docs).agg(F.sum("taken")).first()[0]
    assert mix.agg(words(F.col("text"))).first()[0] == taken


def test_exact_dedup(spark, odd):
    folder, rows = odd
    got = QUERIES["op4_exact_dedup"](spark, folder).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(brute.exact(rows), key=repr)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digest_index_over_batches(spark):
    name = "digest_index_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    first = spark.createDataFrame([(1, "a  b"), (2, "c"), (3, "a b")], "doc_id long, text string")
    second = spark.createDataFrame([(0, "c"), (9, "d"), (8, "d")], "doc_id long, text string")
    exact_dedup.exact_dedup(first, name, 0, buckets=3).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, name, 1, buckets=3).collect()}
    assert got == {0: (0, 2, True), 9: (8, 2, False), 8: (8, 2, True)}
    assert spark.table(name).where("is_new").count() == 3
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(second, name, 1, buckets=3)
    spark.sql(f"DROP TABLE {name}")


def test_batches_are_anti_joined_with_the_index(spark, odd):
    docs, plans = table(spark, odd[0], "documents"), []
    real = exact_dedup.written
    exact_dedup.written = lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "digest-batch" else None) or real(df, name)
    try:
        many = exact_dedup.dedup_in_batches(docs, 5, 3).collect()
    finally:
        exact_dedup.written = real
    assert len(plans) == 4 and all("LeftAnti" in p for p in plans)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in many), key=repr) == sorted(brute.exact(odd[1]), key=repr)


def test_token_counts(spark, odd, sf_dir):
    folder, rows = odd
    model = token_counts.counter(token_counts.vocabulary("piece_bpe_32k.model")).model
    for where, texts in ((folder, rows), (sf_dir, given(spark, sf_dir))):
        want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in texts), key=repr)
        got = QUERIES["op5_token_counts"](spark, where)
        assert rows_of(got.select("doc_id", "n_bytes", "n_tokens")) == want
        for r in got.where("over_limit").collect():
            text = dict(texts)[r.doc_id]
            assert len(model.encode(text[: r.cut_chars])) <= token_counts.LIMIT


def test_every_prefix(odd):
    counter = token_counts.counter(token_counts.vocabulary("piece_bpe_32k.model"))
    for _, text in odd[1]:
        text = (text or "")[:400]
        counts = np.concatenate([[0], np.cumsum(counter.text_steps(text), dtype=int)])
        assert counts.tolist() == [len(counter.model.encode(text[:i])) for i in range(len(text) + 1)]


def test_marginals_by_plain_recursion():
    rng = np.random.default_rng(0)
    model = toxicity.ChainField()
    model.move, model.begin = np.log(np.array([[0.9, 0.1], [0.6, 0.4]])), np.log(np.array([0.8, 0.2]))
    lengths = np.array([5, 300, 1, 128, 129, 256])
    evidence = rng.normal(0, 2, lengths.sum())
    got, at, move = model.marginals(evidence, lengths), 0, np.exp(model.move)
    for n in lengths:
        e = np.exp(evidence[at : at + n])
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = np.exp(model.begin) * [1, e[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ move) * [1, e[t]]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = move @ (b[t + 1] * [1, e[t + 1]])
            b[t] /= b[t].sum()
        p = a * b
        np.testing.assert_allclose(p[:, 1] / p.sum(axis=1), got[at : at + n], atol=1e-9)
        at += n


@pytest.mark.parametrize("key, label, folds, held, least", [("op6_toxicity_spans", "toxic", 5, 0, 0.95), ("op8_quality_compression", "quality", 3, 1, 0.9)])
def test_held_out_accuracy(spark, key, label, folds, held, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    got = QUERIES[key](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) >= least


@pytest.mark.parametrize("key", ["op6_toxicity_spans", "op8_quality_compression"])
def test_scores_of_odd_rows(spark, odd, key):
    folder, rows = odd
    got = QUERIES[key](spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_few_labels_reject_nothing_clean():
    score = lambda texts, labels: toxicity.train(texts, np.array(labels)).score([np.zeros(0)])[0]
    assert score([], []) < 0.5 and score(["a b"] * 3, [0, 0, 0]) < 0.5 and score(["a b"], [1]) > 0.5
    assert 0 <= score(["a b", "c d"], [0, 1]) <= 1


def test_toxic_offsets():
    assert list(toxicity.offsets("a bad, bad day", np.array([0.1, 0.9, 0.8, 0.2]))) == ["2:10"]


def test_token_shards(spark, odd, sf_dir):
    folder, rows = odd
    encoder = token_output.encoder(token_output.vocabulary("word_bpe_49k.json"))
    for where, texts in ((folder, rows), (sf_dir, given(spark, sf_dir))):
        ids = [(i, [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts]
        want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
        got = sorted((tuple(r) for r in QUERIES["op7_token_output"](spark, where).collect()), key=lambda r: r[1])
        assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == want
        assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
        known = [r[0] for r in got if r[0] is not None]
        assert known == sorted(known)


def test_words_of_many_texts_are_encoded_once(monkeypatch):
    encoder = token_output.Encoder(token_output.vocabulary("word_bpe_49k.json"))
    forms = [None, "", " ", "Straße straße, STRAßE!", "It's it's\n\n12 12. a1 'tis <|endoftext|> <|EndOfText|>,", "é é e\u0301\tx\u00a0y ﬁ İ ×÷ 中文", "x" * 100 + "??'"]
    texts = [t if t is None else f"{t} word{mark}" for mark in ("", ",", "'", "***", "<|") for t in forms] * 3
    asked, whole = [], token_output.Encoder.model_ids
    monkeypatch.setattr(token_output.Encoder, "model_ids", lambda self, letters: asked.append(letters) or whole(self, letters))
    ids, bounds = encoder.batch(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) and "straße" in asked and "word" in asked
    parts = token_output.chunks(iter(pa.RecordBatch.from_pydict({"text": [t]}) for t in "abcdefg"), 2 * pa.array(["a"]).nbytes)
    assert [p.column("text").to_pylist() for p in parts] == [["a", "b"], ["c", "d"], ["e", "f"], ["g"]]


def test_workers_give_back_what_a_task_leaves(monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_pydict({"a": rows}) for rows in ([1], [], [2, 3])]))

    shared.give_back()
    done = []
    monkeypatch.setattr(shared, "give_back", lambda: done.append(True))
    rows = shared.per_batch(Frame(), "a long", lambda: lambda batch: batch)
    assert (next(rows).num_rows, done) == (1, [])
    assert ([batch.num_rows for batch in rows], done) == ([2], [True])


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 5000):
        ids = rng.integers(0, 40 if n % 2 else 49408, n).astype(np.uint32)
        matrix, doc_ids, lengths = token_output.from_file(token_output.to_file([ids[: n // 3], ids[n // 3 :]], [None, 7], 16))
        assert (doc_ids, lengths.tolist()) == ([None, 7], [n // 3, n - n // 3])
        assert (matrix.tokens() == ids).all()
        if n:
            assert (matrix.access(np.arange(n)) == ids).all()
            value, half = int(ids[n // 2]), n // 2
            places = np.flatnonzero(ids == value)
            assert matrix.count(value) == len(places) and matrix.count(value, half) == (ids[:half] == value).sum()
            assert [matrix.select(value, k) for k in range(min(3, len(places)))] == places[:3].tolist()
        assert matrix.count(50_000) == 0


def test_contamination(spark, odd, sf_dir):
    for where, texts in ((odd[0], odd[1]), (sf_dir, given(spark, sf_dir))):
        items = [tuple(r) for r in table(spark, where, "benchmark").collect()]
        want = sorted(brute.contaminated(texts, items), key=repr)
        assert rows_of(QUERIES["op9_benchmark_decontamination"](spark, where)) == want
        docs, tests = table(spark, where, "documents"), table(spark, where, "benchmark")
        # several blocks of items give the same rows
        assert rows_of(decontamination.contamination(docs, tests, block_words=40 if where == odd[0] else 600)) == want
        assert decontamination.decontaminated(docs, tests).count() == sum(not r[5] for r in want)


def test_automaton_on_random_words():
    rng = random.Random(2)
    for _ in range(200):
        some = lambda letters, n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(str(i), some("abc", rng.randint(1, 9))) for i in range(rng.randint(1, 5))]
        rows = [(i, some("abcd", rng.randint(0, 30))) for i in range(4)]
        window = rng.randint(1, 5)
        tests = decontamination.TestItems([(i, decontamination.words_of(t)) for i, t in items], window)
        for (_, text), (_, n, n_hit, n_items, _, _) in zip(rows, brute.contaminated(rows, items, window)):
            hit, found = tests.find(decontamination.words_of(text))
            assert (0 if hit is None else int(hit.sum()), len(found)) == (n_hit, n_items)


def test_hit_spans_are_cut():
    assert decontamination.removed("Ab, cd! Ef gh.", np.packbits([0, 1, 1, 0]).tobytes()) == "Ab,  gh."


def test_near_duplicates(spark, odd, sf_dir):
    for where, texts in ((odd[0], odd[1]), (sf_dir, given(spark, sf_dir))):
        known = [(i, t) for i, t in texts if i is not None]
        want = brute.near(known)
        got = QUERIES["op10_minhash_odd_sketch"](spark, where).collect()
        assert len(got) == len(texts)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(want)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        docs = table(spark, where, "documents")
        kept = minhash_odd.deduplicated(docs)
        assert kept.schema == docs.schema
        assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == brute.kept(known)


def test_repeated_doc_ids_lose_no_text(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a), (1, b), (1, c), (2, a + " x"), (3, b + " x"), (4, c + " x"), (5, "nothing alike"), (7, "!" * 9), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_odd.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (6, 6, True), (7, 7, True)}
    kept = sorted((r.doc_id, r.text or "") for r in minhash_odd.deduplicated(docs).collect())
    assert kept == sorted([(1, a), (1, b), (1, c), (5, "nothing alike"), (6, ""), (6, ""), (7, "!" * 9)])


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(i, " ".join(f"v{i}" if k == i % 115 else w for k, w in enumerate(words))) for i in range(400)]
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100)) + " " + " ".join(words[:60])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash_odd.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(rows), key=repr)


def test_odd_sketch_tells_high_similarity():
    rng = np.random.default_rng(4)
    for share, passes in ((0.95, True), (0.8, True), (0.3, False)):
        base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        other = base.copy()
        changed = int(3000 * (1 - share) / (1 + share))
        other[:changed] = rng.integers(0, 2**63, changed, dtype=np.uint64)
        a, b = (minhash_odd.odd_sketch(minhash_odd.samples(np.unique(x))) for x in (base, other))
        assert (sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= minhash_odd.sketch_limit()) == passes


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)]
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    want = {n: p for n, p in parent.items() if n not in loops}
    assert {r.node: r.label for r in components(frame(edges)).collect()} == want
    first = components(frame(edges[::2]))
    assert {r.node: r.label for r in components(frame(edges[1::2]), first).collect()} == want


def test_compression_needs_both_classes():
    model = quality.train(["some text", "other text"], np.array([1, 1]))
    assert len(set(model.score(["a", "", "b" * 3000]).tolist())) == 1
