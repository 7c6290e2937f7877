"""The numbered operators against brute force, their libraries or SQL, over texts at the edges."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import bpe_codec, bpe_count, decontam, katz, line_dedup, quality, queries, simhash, substrings, token_files, toxicity
from tessera.llm import exchange as X
from tessera.llm.components import components
from tessera.llm.huffman import Code, code_lengths
from tessera.llm.suffixes import Strings, merge_sort
from tests.compare import rows_of, rows_of_sql


def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def _docs(spark, docs_dir):
    return spark.read.parquet(f"{docs_dir}/documents.parquet")


def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = queries.QUERIES[name](spark, empty_dir)
    assert not rows.where('n_failed > 0').count() if name == "quality_ablations" else rows.count() == 0  # that one has a row for each rule


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, docs_dir, name):
    got = rows_of(queries.QUERIES[name](spark, docs_dir))
    assert got and got == rows_of_sql(queries.ORACLE_SQL[name], docs_dir)


def test_what_a_query_writes_is_in_one_folder(spark, docs_dir):
    from pathlib import Path

    from tessera.llm import store

    shared = Path(store.shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    out = queries.QUERIES["op8_simhash"](spark, docs_dir)
    assert out.count() and len({p.name for p in set(shared.iterdir()) - before if p.name.startswith("op8_simhash-")}) == 1
    store.done(out)
    assert not [p for p in set(shared.iterdir()) - before if p.name.startswith("op8_simhash-")]


# toxicity


def test_toxicity_learns_and_reads_only_the_text(spark, docs_dir):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.train(docs, labels, sample=250)
    held = toxicity.score(docs, net).join(labels, "doc_id").where(toxicity.fold(labels.doc_id) == 0).select("toxic", "score").collect()
    s, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert above > 0.85, above
    edge = _docs(spark, docs_dir)
    other = edge.selectExpr("doc_id", "text", "'xx' AS lang", "'other' AS source", "0 AS toxic")
    assert _rows(toxicity.score(edge, net), "doc_id", "score") == _rows(toxicity.score(other, net), "doc_id", "score")
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, net).collect())
    kept = toxicity.clean(edge, net)
    assert kept.columns == edge.columns and kept.count() < edge.count() + 1


def test_toxicity_query_columns(spark, docs_dir, texts):
    got = queries.op1_toxicity(spark, docs_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_toxicity_without_labels(spark, docs_dir):
    docs, none = _docs(spark, docs_dir), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.query(docs, none).collect()} == {0.5}
    assert toxicity.clean(docs, None).count() == docs.count()


def test_toxicity_fits_on_every_chosen_id_beside_a_hot_one(spark, monkeypatch):
    hot, *ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 > 1]
    rows = [(hot, f"calm words {k}", "en") for k in range(5000)] + [(k, ("vile" if k % 2 else "calm") + f" words {k}", "en") for k in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(hot, 0)] + [(k, k % 2) for k in ids], "doc_id long, toxic int")
    fitted, fit = Counter(), toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda texts, y: fitted.update(y.tolist()) or fit(texts, y))
    assert toxicity.train(docs, labels, sample=400) is not None
    assert fitted.total() > 0.7 * len(ids) and min(fitted[0], fitted[1]) > 0.3 * len(ids)


def test_toxicity_cuts_by_language_come_from_the_whole_fold(spark):
    hard = lambda k: k % 5 == 0
    lang = lambda k: "it" if k % 50 == 7 else "es" if k % 6 == 3 else "de" if k % 3 else "en"
    texts = {k: (f"calm words {k} " + ("vile " if hard(k) else "")) * (2000 if hard(k) else 1) if k < 2400 else f"vile words {k}" for k in range(2700)}
    docs = spark.createDataFrame([(k, t, lang(k)) for k, t in texts.items()], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, int(k >= 2400)) for k in texts], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, sample=60)
    aside = [k for k in range(2400) if zlib.crc32(str(k).encode()) % 5 == 1]
    of_lang = Counter(map(lang, aside))
    assert of_lang["it"] < toxicity.FEW <= of_lang["es"] < toxicity.CLEAN <= of_lang["de"]
    assert set(net.thresholds) == {None} | {x for x, n in of_lang.items() if n >= toxicity.FEW}
    logit = lambda x: np.log(x / (1 - x))
    for of, cut in net.thresholds.items():
        own = [k for k in aside if of in (None, lang(k))]
        s = np.sort(net.scores([texts[k].encode() for k in own]))[::-1]
        want = s[len(s) // toxicity.CLEAN]
        floor = toxicity.LEAST if len(s) >= toxicity.CLEAN else net.thresholds[None]
        assert (s >= cut).sum() <= len(s) // toxicity.CLEAN and (cut == floor or abs(logit(cut) - logit(want)) < 1 / toxicity.BINS)
    net.thresholds |= {"de": 0.25}
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(texts) and all(r.rejected == (r.score >= r.threshold) for r in got)
    assert all(r.threshold == net.thresholds.get(lang(r.doc_id), net.thresholds[None]) for r in got)
    assert {r.doc_id for r in toxicity.clean(docs, net).collect()} == {r.doc_id for r in got if not r.rejected}


def test_toxicity_cuts():
    bins = [(9, 1, 0.9), (5, 2, 0.6), (3, 500, 0.2)]
    assert toxicity._threshold(bins, 0.5) == np.nextafter(0.6, 2) and toxicity._threshold([(3, 500, 0.02)], 0.5) == toxicity.LEAST
    assert toxicity._threshold([(9, 1, 0.9), (3, 60, 0.2)], 0.5) == np.nextafter(0.9, 2) and toxicity._threshold([(3, 60, 0.2)], 0.5) == 0.5


def test_toxicity_labels_of_absent_documents_take_no_place(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 > 1]
    docs = spark.createDataFrame([(k, ("vile" if k % 2 else "calm") + f" words {k}", "en") for k in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int").unionByName(spark.range(10_000, 60_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic"))
    net = toxicity.train(docs, labels, sample=100)
    assert net is not None and net.scores([b"vile words"])[0] > 0.5 > net.scores([b"calm words"])[0]


def test_toxicity_sample_takes_languages_in_turn_and_long_texts(spark, monkeypatch):
    ids = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 5 > 1]
    lang = lambda k: "de" if k % 40 < 2 else "en"
    docs = spark.createDataFrame([(k, f"{lang(k)} words {k} " * (4000 if k % 7 == 0 else 1), lang(k)) for k in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    fitted, fit = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda texts, y: fitted.extend(texts) or fit(texts[:10], np.arange(10) % 2))
    toxicity.train(docs, labels, sample=60)
    assert len(fitted) == 120 and sum(t.startswith(b"de") for t in fitted) > 50 and max(map(len, fitted)) > 40_000


def _naive_score(net, text):
    """The network, word by word."""
    rows, _ = toxicity.features([text])
    x = [sum(net.table[r].astype(float) for r in own) for own in rows] or [np.zeros(toxicity.DIM)]
    at = lambda k: x[k] if k < len(x) else np.zeros(toxicity.DIM)
    pooled = []
    for w, f, b in zip(toxicity.WIDTHS, net.filters, net.biases):
        for c in range(toxicity.FILTERS):
            pooled.append(max(0.0, max(b[c] + sum(at(k + j) @ f[j][:, c].astype(float) for j in range(w)) for k in range(len(x)))))
    return 1 / (1 + math.exp(-(np.dot(pooled, net.out) + net.bias)))


def _some_network(spread=0.3):
    rng = np.random.default_rng(5)
    f, d = toxicity.FILTERS, toxicity.DIM
    return toxicity.Network(
        rng.normal(0, spread, (toxicity.ROWS, d)).astype(np.float32),
        [rng.normal(0, spread, (w, d, f)).astype(np.float32) for w in toxicity.WIDTHS],
        [rng.normal(0, 0.1, f).astype(np.float32) for _ in toxicity.WIDTHS],
        rng.normal(0, spread, f * len(toxicity.WIDTHS)).astype(np.float32),
        0.1,
    )


def test_toxicity_scores_equal_a_naive_convolution(texts):
    net = _some_network()
    some = [t.encode() for _, t in texts if len(t) < 3000]
    assert np.allclose(net.scores(some), [_naive_score(net, t) for t in some], atol=1e-5)


def test_toxicity_gradients_equal_finite_differences():
    net = _some_network()
    texts, y = [b"a vile word of it", b"", b"calm words", b"one"], np.array([1, 0, 0, 1], np.float32)
    made = [toxicity.features([t]) for t in texts]
    rows, first = np.concatenate([m[0] for m in made]), np.cumsum([0, *(len(m[0]) for m in made)])
    g = toxicity.gradients(net, rows, first, y)

    def loss():
        s = np.array([_naive_score(net, t) for t in texts])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    def check(array, index, want):
        old, h = array[index], 1e-3
        array[index] = old + h
        up = loss()
        array[index] = old - h
        down = loss()
        array[index] = old
        assert math.isclose((up - down) / (2 * h), want, rel_tol=0.02, abs_tol=2e-4)

    for q in range(len(toxicity.WIDTHS)):
        for index in [(0, 0, 0), (q, 3, 5), (q, 7, 2)]:
            check(net.filters[q], index, g.filters[q][index])
        check(net.biases[q], 1, g.biases[q][1])
    for k in range(0, len(net.out), 5):
        check(net.out, k, g.out[k])
    for k in range(0, len(g.spots), 7):
        check(net.table, (g.spots[k], k % toxicity.DIM), g.table[k, k % toxicity.DIM])


# token files


def test_huffman_lengths_are_optimal_under_the_limit():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 300, 3000):
        counts = rng.zipf(1.3, n)
        lengths = code_lengths(counts, 12).astype(float)
        assert lengths.max() <= 12 and (n == 1 or math.isclose((2.0**-lengths).sum(), 1))
        ids = rng.choice(n, 5000, p=counts / counts.sum())
        code = Code(code_lengths(counts, 12))
        assert (code.unpack(code.pack(ids)) == ids).all() and len(code.unpack(code.pack(ids[:0]))) == 0
    assert code_lengths(np.array([1, 1, 2, 4, 0, 8]), 16).tolist() == [4, 4, 3, 2, 0, 1]
    assert code_lengths(np.array([1, 1, 2, 4, 8]), 3).max() == 3


def test_cut_block_is_noticed():
    code = Code(code_lengths(np.array([5, 3, 1])))
    block = code.pack(np.array([0, 1, 2] * 50))
    with pytest.raises(ValueError):
        code.unpack(block[:-1])


def test_token_files(spark, docs_dir, texts):
    t = _tokenizer("word_bpe_49k.json")
    got = queries.op2_token_files(spark, docs_dir).collect()
    want = Counter()
    for i, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_plain_words_are_put_together_from_pieces(texts, monkeypatch):
    path, rng, t = public_tokenizers.path("word_bpe_49k.json"), random.Random(5), _tokenizer("word_bpe_49k.json")
    made = ["".join(rng.choices("abcdefst019.,;:!?-_()\"<>|/@#`~^{}[]'\x1c\x7f\u00e9", k=rng.randint(1, 9))) for _ in range(4000)]
    odd = ["don't", "'s", "a's.", "it'll", "x1y22", "<|endoftext|>", "a<|endoftext|>b", "<|", "ABC,def", "e\u0301!", "\u00c9a", "l\u1e9e"]
    every = [x for _, x in texts] + made + odd + [" ".join(made[k : k + 40]) for k in range(0, 4000, 40)]
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u2").tobytes() for x in every]
    for most in (1_000_000, 3):
        monkeypatch.setattr(token_files, "REMEMBERED", most)
        monkeypatch.setattr(token_files, "_KNOWN", {})
        assert token_files._encode([x.encode() for x in every], path, "<u2", b"\2\0") == want
    monkeypatch.setattr(token_files, "_KNOWN", {})
    whole = token_files._Ids(path, "<u2")
    whole.tokenizer = None  # plain words go by their pieces alone, each encoded once
    assert whole[b"word,"] == whole[b"word"] + whole[b","] and set(whole) == {b"word", b",", b"word,"}


def test_token_files_with_one_hot_id(spark, tmp_path):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(300)] + [(k, "x") for k in range(5)], "doc_id long, text string").repartition(4)
    token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "f"))
    got = sorted(token_files.read(spark, str(tmp_path / "f"), digests=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 305 and all(r.ids[-1] == 2 for r in got)
    assert spark.read.parquet(str(tmp_path / "f/blocks")).select("part").distinct().count() > 1


# language model


@pytest.mark.parametrize(("order", "buckets"), [(2, 4), (3, 4), (3, 60), (4, 60)])
def test_katz_equals_brute_force(spark, docs_dir, texts, monkeypatch, order, buckets):
    monkeypatch.setattr(katz.X, "partitions", lambda docs: buckets)  # many: histories are hot, in part
    got = katz.score(_docs(spark, docs_dir), order, block_bytes=50_000).collect()
    rows = [(i, [b"\n"] * (order - 1) + t.encode().lower().split() + [b""]) for i, t in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = {k: Counter() for k in range(1, order + 1)}
    history = {k: Counter() for k in range(1, order + 1)}
    for i, w in rows:
        for k in range(order - 1, len(w)) if not held(i) else ():
            for m in count:
                count[m][tuple(w[k - m + 1 : k + 1])] += 1
                history[m][tuple(w[k - m + 1 : k])] += 1
    n, v = sum(count[1].values()), len(count[1])
    d = {m: katz.discounts([sum(x == r for x in c.values()) for r in range(7)]) for m, c in count.items()}
    cut = lambda r, m: d[m][r] * r if r <= 5 else r - katz.SLIVER
    unseen = 1 - sum(cut(r, 1) for r in count[1].values()) / n
    after = {m: defaultdict(list) for m in count}
    for m, c in count.items():
        for g in c:
            after[m][g[:-1]].append(g)
    weights = {}

    def one(g):
        m = len(g)
        if m == 1:
            return cut(count[1][g], 1) / n if count[1][g] else unseen
        h = g[:-1]
        if count[m][g]:
            return cut(count[m][g], m) / history[m][h]
        if not history[m][h]:
            return one(g[1:])
        if h not in weights:
            weights[h] = (1 - sum(one(x) for x in after[m][h])) / (1 - sum(one(x[1:]) for x in after[m][h]))
        return weights[h] * one(g[1:])

    common = [h for h, _ in history[order].most_common(3)]
    for h in [*common, *(h[1:] for h in common)]:
        assert math.isclose(sum(one((*h, b)) for (b,) in count[1]) + one((*h, b"\t")), 1)
    want = []
    for i, w in rows:
        own = w[order - 1 :]
        base = sum(math.log10((count[1][b,] + 0.1) / (n + 0.1 * (v + 1))) for b in own)
        value = sum(math.log10(one(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w)))
        want.append((i, held(i), len(own), sum(count[1][b,] > 0 for b in own), n, base, value))
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5] and math.isclose(g[5], x[5], abs_tol=1e-6) and math.isclose(g[6], x[6], abs_tol=1e-6)


def _resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_workers_give_back_what_a_task_needed():
    def run(batches):
        for _ in batches:
            held = [np.ones(12_000) for _ in range(3000)]  # 290 MB in pieces too small for maps of their own
            yield held[-1]  # the last piece stays, so that the heap's top can't fall by itself

    before = _resident()
    kept = list(X.tidy(run)([0]))
    assert len(kept[0]) == 12_000 and _resident() - before < 100


def test_codec_starts_no_workers_for_its_vocabulary(spark, monkeypatch):
    docs = spark.sql("select 1L as doc_id, 'a b' as text")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a: pytest.fail("rows went through workers for RDDs"))
    assert bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=False).first().decoded == "a b"


def test_katz_pairs_words_without_sorting_where_numbers_fit(monkeypatch):
    rng = np.random.default_rng(3)
    unique, sorts = np.unique, []
    monkeypatch.setattr(katz.np, "unique", lambda *a, **b: sorts.append(1) or unique(*a, **b))
    for n, sorted_once in ((1000, 0), (1 << 20, 0), (1 << 22, 1)):
        words = [rng.integers(max(0, n - 50), n, 4000) for _ in range(3)]
        sorts.clear()
        code = katz._paired(words[0], words[1], n)
        assert len(sorts) == sorted_once and (int(code.max()) + 1) * n <= 1 << 63
        code = code * n + words[2]
        assert (unique(code, return_inverse=True)[1] == unique(np.stack(words), axis=1, return_inverse=True)[1].ravel()).all()
    assert len(katz._paired(np.zeros(0, np.int64), np.zeros(0, np.int64), 5)) == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_counts_a_bucket_in_parts(order):
    rng, model = np.random.default_rng(5), katz.Model(10**6, 2000, 50, 10**6, {m: katz.discounts([0, 100, 40, 20, 12, 8, 6]) for m in (1, 2)}, 1e-6, {})
    rows = []
    for block in range(8):
        grams = np.unique(rng.zipf(1.3, (60_000, order)) % 2000, axis=0)  # sorted by the word before the last one, the last is the last
        numbers, zeros = (np.arange(2000) * 7 + 3).astype(np.uint64), np.zeros(len(grams), np.int64)
        flags = rng.integers(0, 2, len(grams)).astype(np.uint8)
        rows.append((4, block, X.press(X.deltas(numbers), np.arange(2000), rng.integers(0, 3, len(grams)).astype(np.uint32), zeros, zeros, flags, *katz._steps(list(grams.T)))))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["bucket", "block", "blob"])

    def run(limit):
        tracemalloc.start()
        out = pa.Table.from_batches(katz._counted([batch], order, model, limit)).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        answers = {r["block"]: [x.tolist() for x in X.expand(r["body"], np.int64, np.uint32, np.float64)] for r in out if r["kind"] == order}
        return answers, np.sum([r["n"] for r in out if r["kind"] == katz.SUMS], axis=0).tolist(), peak

    (whole, sums, most), (parts, same, less) = run(10**9), run(20_000)
    assert parts == whole and same == sums and len(whole) == 8 and less < most / 2


def test_katz_survives_another_split_of_its_files(spark, docs_dir):
    want = _rows(katz.score(_docs(spark, docs_dir)), "doc_id", "n_tokens", "n_known")
    later = katz.score(_docs(spark, docs_dir))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert _rows(later, "doc_id", "n_tokens", "n_known") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_discounts_stay_proper():
    for counts in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 100, 40, 20, 12, 8, 6], [0, 1, 9, 1, 9, 1, 9]):
        d = katz.discounts(counts)
        assert (d[1:] > 0).all() and (d[1:] < 1).all()


# repeated strings


def test_suffixes_are_sorted():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    data = np.frombuffer("".join(words).encode() + b"!", np.uint8)
    size = np.array([len(w) for w in words])
    spot = np.cumsum(size) - size
    strings = Strings(data, spot, np.zeros(200, np.int64), size)
    order = merge_sort(strings, np.zeros(200, np.int64), np.full(200, 200))
    assert [words[k] for k in order] == sorted(words)
    back = merge_sort(Strings(data, spot + size, size, np.zeros(200, np.int64)), np.zeros(200, np.int64), np.full(200, 200), False)
    assert [words[k][::-1] for k in back] == sorted(w[::-1] for w in words)


def _cut(texts):
    seen = Counter()
    raw = [(i, t.encode()) for i, t in texts]
    for _, t in raw:
        for k in range(len(t) - 199):
            seen[hash(t[k : k + 200])] += 1
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_strings(spark, docs_dir, texts):
    got = queries.op4_repeated_strings(spark, docs_dir)
    assert _rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _cut(texts)


@pytest.mark.parametrize("hot", [0, 40, substrings.HOT])
def test_repeated_strings_around_one_passage(spark, tmp_path, hot):
    rng = random.Random(3)
    passage = "".join(rng.choice("abc def ghi") for _ in range(400))
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rows = [(k, some("xyz uvw", 300) + passage[rng.randint(0, 150) : rng.randint(200, 400)] + some("qrs", 150)) for k in range(150)]
    rows += [(500, passage[:200]), (501, passage[:200]), (502, passage * 2), (503, "q" + passage[:199]), (504, "abc" * 400 + "d" + "abc" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = substrings.remove_repeats(spark.read.parquet(str(tmp_path / "d")), hot=hot)
    assert _rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _cut(rows)


def test_repeated_strings_split_whatever_occurs_twice(spark, docs_dir, texts):
    got = substrings.remove_repeats(spark.read.parquet(f"{docs_dir}/documents.parquet"), hot=1)
    assert _rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _cut(texts)


def test_groups_around_a_hot_anchor_stay_small():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260)).encode()
    texts = [passage + "".join(rng.choice("ab") for _ in range(200)).encode() for _ in range(2_000)]
    text, at, _, least, greatest = substrings.anchors(texts)
    inside = at + substrings.GRAM <= len(passage)
    groups = defaultdict(set)
    for key, t, start, _, end in substrings._by_segment(texts, *(x[inside] for x in (text, at, least, greatest))):
        groups[key].add(texts[t][start:end])
    assert max(map(len, groups.values())) <= 2 ** (2 * (substrings.PLACES - 1))


def test_suffixes_are_sorted_with_colliding_hashes(monkeypatch):
    """Prefix hashes cut to two bits: collisions are found and the work goes on by bytes."""
    from tessera.llm import suffixes as S

    r = random.Random(11)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(30, 60))) for _ in range(60)] + [b"ab" * 20, b"ab" * 25, b"aab" * 15]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    left = np.array([r.randrange(len(t)) for t in texts])
    spot = ends - [len(t) for t in texts] + left
    right = ends - spot
    group = np.array([0] * 40 + [40] * 23)
    size = np.where(group == 0, 40, 23)
    want = S.repeated_around(Strings(data, spot, left, right), group, size, 12)
    monkeypatch.setattr(Strings, "_same", lambda self, a, b, n: ((self.prefix[a + n] - self.prefix[a]) * self.down[a]) & np.uint64(3) == ((self.prefix[b + n] - self.prefix[b]) * self.down[b]) & np.uint64(3))
    got = S.repeated_around(Strings(data, spot, left, right), group, size, 12)
    assert all((x == y).all() for x, y in zip(got, want)) and want[1].any()
    for forward in (True, False):
        order, _ = S.sorted_groups(Strings(data, spot, left, right), group, size, forward)
        own = [t[at:] if forward else t[:at][::-1] for t, at in zip(texts, left.tolist())]
        assert [(group[i], own[i]) for i in order] == sorted((g, x) for g, x in zip(group, own))


# BPE


def test_bpe_codec(spark, docs_dir, texts):
    t = _tokenizer("byte_bpe_50k.json")
    want = []
    for i, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert _rows(queries.op5_bpe_codec(spark, docs_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    whole = bpe_codec.encode_decode(_docs(spark, docs_dir), public_tokenizers.path("byte_bpe_50k.json"), digests=False)
    assert _rows(whole, "doc_id", "decoded") == sorted(texts, key=repr)
    assert [x for _, x in _rows(whole, "doc_id", "ids")] == [t.encode(x, add_special_tokens=False).ids for _, x in sorted(((i, x) for i, x in texts), key=lambda r: repr((r[0], t.encode(r[1], add_special_tokens=False).ids)))]
    plan = _plan(whole)
    assert plan.count("Join") >= 2 and "FlatMapCoGroupsInArrow" in plan  # pieces by id, words by word; then blocks by block


def test_words_are_cut_where_no_token_reaches_over(spark, texts):
    from tessera.llm.exchange import glued_words

    rows = spark.createDataFrame([(x,) for _, x in texts] + [("a\u0085 b\ufeff\tc \u200b d\x1f e",)], "text string")
    got = rows.selectExpr("text", f"filter(split(text, r'{bpe_codec.CUT}', -1), w -> w <> '') AS words").collect()
    assert all(r.words == [w.decode() for w in glued_words(r.text.encode())] for r in got)


def test_cutting_words_looks_for_the_blank_first(spark):
    import time

    text = "a few words, and longer ones: uncharacteristically " * 20_000
    docs = spark.createDataFrame([(text,)] * 4, "text string").repartition(1).cache()
    cut, ahead = bpe_codec.CUT, r"(?=[\t-\r ])"
    assert cut.count(ahead) == 1

    def seconds(pattern):
        began = time.perf_counter()
        assert docs.selectExpr(f"size(split(text, r'{pattern}', -1)) AS n").first().n == len(text.split()) + 1
        return time.perf_counter() - began

    slow, fast = (min(seconds(x) for _ in range(4)) for x in (cut.replace(ahead, "") + ahead, cut))
    assert fast < 0.7 * slow


def test_rows_of_a_block_travel_in_packets():
    rows = [(k % 3, 10**12 + k, k * 7 % 5000, f" word{k}".encode(), None if k % 11 else b"\xff%d" % k) for k in range(5000)]
    schema = pa.schema([("home", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("word", pa.binary()), ("other", pa.binary())])
    batches = [pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows[k : k + 700]], schema).to_batches()[0] for k in range(0, 5000, 700)]
    for limit, most in ((5000, 3), (1400, 12), (1, 24)):
        sent = [(h, blob) for b in bpe_codec._packets(batches, limit) for h, blob in zip(*(c.to_pylist() for c in b.columns))]
        assert len(sent) == most
        got = [(h, *r) for h, blob in sent for n, t in [bpe_codec._unframed(blob, 2, 2)] for r in zip(*(x.tolist() for x in n), *(x.to_pylist() for x in t))]
        assert sorted(got, key=repr) == sorted(rows, key=repr)
    sent = [blob for b in bpe_codec._packets(batches) for blob in b.column(1).to_pylist()]
    assert len(sent) == 3 and sum(map(len, sent)) < 0.5 * sum(b.nbytes for b in batches)
    assert not list(bpe_codec._packets([batches[0].slice(0, 0)]))


def _resplit(monkeypatch, change):
    """Tables that operators write are followed by ``change``, so that later steps split their input otherwise."""
    from tessera.llm import store

    written = store.written

    def then(*args, **named):
        out = written(*args, **named)
        change()
        return out

    monkeypatch.setattr(store, "written", then)


@pytest.mark.parametrize("name", ["op4_repeated_strings", "op5_bpe_codec", "op12_collocations"])
def test_blocks_survive_another_split_of_the_input(spark, tmp_path, monkeypatch, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    want = rows_of(queries.QUERIES[name](spark, str(tmp_path)))
    sizes = iter([4 << 20, 1 << 14, 128 << 20, 1 << 13] * 9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    _resplit(monkeypatch, lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes))))
    try:
        assert rows_of(queries.QUERIES[name](spark, str(tmp_path))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_token_counts(spark, docs_dir, texts):
    t = _tokenizer("byte_bpe_50k.json")
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in texts]
    assert _rows(queries.op10_token_counts(spark, docs_dir), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_of_every_character(spark):
    """Each code point before a contraction and inside a word; the library's own Unicode tables decide."""
    t = _tokenizer("byte_bpe_50k.json")
    points = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    texts = [" ".join(f"{c}'t x{c}y" for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    counter = bpe_count.MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))
    assert [counter.text(x.encode()) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


# quality


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ablations_are_sums_over_the_ledger(spark, docs_dir):
    table = quality.stored_ledger(_docs(spark, docs_dir))
    assert "MapInArrow" not in _plan(quality.ablations(table, "v2")) and "MapInArrow" not in _plan(quality.apply_policy(table, "v1"))
    assert {r.rules for r in table.collect()} == {quality.RULES_VERSION}
    alone = Counter(r.sole_failure for r in quality.apply_policy(table, "v2").collect())
    assert all(alone[quality.BIT[r.rule]] == r.n_only for r in quality.ablations(table, "v2").collect())
    failed = [r.failed for r in table.collect()]
    mask = quality.POLICIES["v2"]
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(table, "v2").collect()}
    for name, bit in quality.BIT.items():
        assert got[name] == (sum(f & bit > 0 for f in failed), sum(f & mask == bit for f in failed), sum(f & mask & ~bit == 0 for f in failed))
    base = {r.doc_id for r in quality.apply_policy(table, "base").where("not kept").collect()}
    assert base <= {r.doc_id for r in quality.apply_policy(table, "v2").where("not kept").collect()}


# decontamination


def test_decontamination_with_a_crowded_filter(spark, docs_dir, monkeypatch):
    docs, items = _docs(spark, docs_dir), spark.read.parquet(f"{docs_dir}/benchmark.parquet")
    whole = rows_of(decontam.query(docs, items))
    monkeypatch.setattr(decontam, "FILTER_BITS", 128)  # passes most shingles; the joins decide
    assert rows_of(decontam.query(docs, items)) == whole
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == decontam.contamination(docs, items).where("not contaminated").count()


def test_decontamination_keeps_nothing_but_words_near_prefixes(spark, docs_dir):
    docs, items = _docs(spark, docs_dir).select("doc_id", "text"), spark.read.parquet(f"{docs_dir}/benchmark.parquet")
    prefix = decontam.prefixes(docs, decontam.windows(items).select("window").distinct())
    assert prefix.count() == prefix.select("window").distinct().count()
    near = decontam.candidates(docs.selectExpr("doc_id", "text", "cast(null AS binary) AS tag"), prefix, decontam.WINDOW).selectExpr("inline(near)").collect()
    assert near and all(len(r.text.split(" ")) < 2 * decontam.WINDOW for r in near)


# SimHash


def _fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _joined(n, linked):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_simhash(spark, docs_dir, texts):
    fps = [(i, _fingerprint(t)) for i, t in texts]
    roots = _joined(len(fps), lambda a, b: (fps[a][1] ^ fps[b][1]).bit_count() <= 3)
    least = {r: min((fps[k][0] for k in range(len(fps)) if roots[k] == r and fps[k][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, f"{f:016x}", least[roots[k]]) for k, (i, f) in enumerate(fps)), key=repr)
    docs = _docs(spark, docs_dir)
    assert _rows(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want


def test_one_row_of_each_group_stays(spark, docs_dir, texts):
    docs = _docs(spark, docs_dir)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    fps = [_fingerprint(t) for _, t in texts]
    roots = _joined(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    own, of = {(i, t): r for (i, t), r in zip(texts, roots)}, defaultdict(list)
    for (i, _), r in zip(texts, roots):
        of[r].append(i)
    got = [(r.doc_id, own[r.doc_id, r.text or ""]) for r in kept.collect()]
    assert sorted(r for _, r in got) == sorted(of)
    assert all(i == min((x for x in of[r] if x is not None), default=None) for i, r in got)
    assert [i for i, _ in got].count(9001) == 2


def test_one_row_of_each_group_stays_where_an_id_has_many_texts(spark):
    docs = spark.createDataFrame([(3, "text a of the group"), (5, "text a of the group"), (5, "another one alone"), (None, "nobody's own"), (None, "nobody's own"), (None, "text a of the group")], "doc_id long, text string")
    want = [(3, "text a of the group"), (5, "another one alone"), (None, "nobody's own")]
    assert _rows(corpus_pipeline.one_of_near_copies(spark, docs, ""), "doc_id", "text") == sorted(want, key=repr)


def test_columns_of_any_name_pass_through_the_stages(spark):
    """Names that the stages might use for themselves, among them earlier ones."""
    names = ["__key", "__kept", "__tag", "key", "tag", "row", "first", "root", "at", "near", "words", "lines"]
    texts = ["one two three four five six\na\nb\nc", "one two three four five six\na\nb\nc", "quite another text of a few words\na\nb\nc", "solo"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"concat(doc_id, '{n}') AS {n}" for n in names])
    items = spark.createDataFrame([("i", "solo")], "item_id string, text string")
    net = _some_network()
    net.thresholds = {None: 2.0}
    out = line_dedup.dedup_lines(toxicity.clean(docs, net), length_col="n_chars")
    out = decontam.clean(simhash.one_of_each(out), items)
    assert out.columns == docs.columns
    got = {r.doc_id: r.asDict() for r in out.collect()}
    assert 3 not in got and 2 in got and all(r[n] == f"{i}{n}" for i, r in got.items() for n in names)


@pytest.mark.parametrize("heavy", [4096, 8])
def test_links_find_every_pair_in_radius(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng, fps = random.Random(1), set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(simhash._signed(x))
    fps = sorted(fps)
    u = [x % (1 << 64) for x in fps]
    want = _joined(len(fps), lambda a, b: (u[a] ^ u[b]).bit_count() <= 3)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    groups = lambda of: sorted(sorted(g) for g in of.values())
    a, b = defaultdict(list), defaultdict(list)
    for k, x in enumerate(fps):
        a[want[k]].append(x)
        b[got.get(x, x)].append(x)
    assert groups(a) == groups(b)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 99), (7, 7), (100, 99)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {99: 99, 100: 99}


def test_masks_cover_every_three_bits():
    masks = simhash.masks()
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(3000):
        bits = sum(1 << k for k in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)
    for m in masks:
        chunks = simhash.free_chunks(m)
        assert sum(chunks) == ~m & (1 << 64) - 1 and len(chunks) == 4


# line dedup


def test_line_dedup_keeps_columns_and_length(spark, docs_dir):
    docs = _docs(spark, docs_dir)
    got = line_dedup.dedup_lines(docs, length_col="n_chars")
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r.doc_id: r for r in got.where("doc_id in (9009, 9010, 9002)").collect()}
    assert by[9009].text.startswith("x\nline 0") and by[9010].text == "" and by[9010].n_chars == 0 and by[9002].text is None
    assert dict(got.dtypes) == dict(docs.dtypes)
