"""The pipeline's stages on the odd tables, each against the plain version on its own input."""

import sys
import zlib
from pathlib import Path

import brute
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_queries import compare, connect  # noqa: E402

from statwarden.llm import ORACLES, curriculum, token_output, toxicity  # noqa: E402
from statwarden.llm.registry import table  # noqa: E402


def test_stages(spark, sf_dir):
    corpus_pipeline.settings(spark)
    docs = table(spark, sf_dir, "documents")
    labels, items = table(spark, sf_dir, "labels"), [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.trained(docs, labels)).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        ids = sorted(r.doc_id for r in after.collect())
        if name == "toxicity":
            assert ids == sorted(i for i, _ in before if scores[i] < 0.5)
        elif name == "near_dedup":
            assert ids == brute.kept(before)
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in brute.contaminated(before, items) if not r[5])
        elif name == "mixing":
            taken = {r.doc_id: (r.taken, r["size"]) for r in curriculum.curriculum(docs).collect()}
            assert ids == sorted(i for i, (t, s) in taken.items() for _ in range((t > 0) + (t > s)))
        else:
            tokenizer = token_output.encoder(token_output.vocabulary("word_bpe_49k.json")).tokenizer
            crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
            assert sorted((r.doc_id, r.ids_crc32) for r in after.collect()) == sorted((i, crc(t)) for i, t in before)
        if name != "token_output":
            assert after.columns == docs.columns
        docs = after


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_run_on_odd_and_empty_tables(spark, request, which):
    folder = request.getfixturevalue(which)
    folder = folder if which == "empty" else folder[0]
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_queries_against_sql(spark, sf_dir, key):
    assert compare(spark, connect(sf_dir), sf_dir, key).startswith("ok")
