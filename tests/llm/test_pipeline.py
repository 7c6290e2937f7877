"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import store, toxicity
from tests.llm.test_operators import _fingerprint, _joined

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage on a small table."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        then = store.written(stage(spark, docs, sf), name)
        out[name] = (docs, then)
        docs = then
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (_, out) in stages.items():
        assert name == "bpe" or out.columns == COLUMNS


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0")
    clean = before.join(labels, "doc_id", "left_semi").count()
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.95 * clean
    assert toxicity.clean(before, None).count() == before.count()


def test_line_dedup(stages):
    before, after = (_texts(x) for x in stages["line_dedup"])
    seen, want = set(), {}
    for i in sorted(before):
        lines, gone = before[i].split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert after == want


def test_simhash(stages):
    before, after = (_texts(x) for x in stages["simhash"])
    ids = sorted(before)
    fps = [_fingerprint(before[i]) for i in ids]
    roots = _joined(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least = {}
    for i, r in zip(ids, roots):
        least.setdefault(r, i)
    assert set(after) == set(least.values()) and all(after[i] == before[i] for i in after)


def test_decontamination(spark, stages):
    before, after = (_texts(x) for x in stages["decontamination"])
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower())
    windows = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert set(after) == {i for i, t in before.items() if not hit(words(t))}


def test_bpe(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages["bpe"]
    texts = _texts(before)
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages["bpe"][1].collect()}


def test_run_on_edges(spark, docs_dir):
    got = [r.doc_id for r in corpus_pipeline.run(spark, docs_dir).collect()]
    assert len(got) > 50 and sum(i in (9002, 9003, 9004) for i in got) <= 1  # texts without words are copies of each other
    assert 9014 not in got and -3 not in got  # hold benchmark windows


def test_run_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
