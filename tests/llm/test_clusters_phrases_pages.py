"""Operators 11 to 13 against brute force, finite differences and held-out pages."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import clusters, crf, extraction, page_samples, phrases
from tessera.llm.page_blocks import Reader

# clusters


def _clustered(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept))
    centers = [v for _, _, v in seeds[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for c in range(len(centers)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            centers[c] = [sum(x) // len(own) for x in zip(*own)] if own else centers[c]
    of = [near(v) for _, v in kept]
    d = [far(v, centers[o]) for (_, v), o in zip(kept, of)]
    by = [sum(x for x, o in zip(d, of) if o == c) for c in range(len(centers))]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, o, fits(x), fits(by[o]), fits(sum(d)), hashlib.sha256(",".join(map(str, centers[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, of, d)]


def _names(df):
    return sorted((tuple(r[n] for n in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def test_clusters_equal_brute_force(spark, docs_dir):
    vectors = spark.read.parquet(f"{docs_dir}/embeddings.parquet")
    fetched = []
    got = _names(clusters.cluster(vectors, rounds=4, fetched=fetched))  # ten rounds are compared with SQL
    assert got == sorted(_clustered([(r.vec_id, r.embedding) for r in vectors.collect()], rounds=4), key=repr)
    assert fetched[0][0] == fetched[0][1] and fetched[-1][1] < fetched[-1][0] // 2  # at first all are new, then few are fetched


def test_clusters_of_huge_and_few_vectors(spark):
    r = random.Random(5)
    rows = [(k, [r.choice((1e38, -3e37, 1e12, 0.1, -0.3)) * r.random() for _ in range(64)]) for k in range(20)] + [(k, [r.random() for _ in range(64)]) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    stored = [(x.vec_id, x.embedding) for x in df.collect()]
    assert _names(clusters.cluster(df, centroids=4, rounds=2)) == sorted(_clustered(stored, 4, 2), key=repr)
    assert _names(clusters.cluster(df.where("vec_id > 36"), rounds=1)) == sorted(_clustered([x for x in stored if x[0] > 36], 8, 1), key=repr)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_intervals_hold_distances(bits):
    g = np.random.Generator(np.random.PCG64(bits))
    x = g.normal(size=(200, 64)) * g.choice([0.01, 1, 50], 64)
    v = clusters.integers(x.tolist())
    cells = clusters.Cells(x[:40], x.min(axis=0).tolist(), x.max(axis=0).tolist(), bits)
    packed = [c.tobytes() for c in cells.of(v)]
    assert all(len(c) == 8 * bits for c in packed)
    centers = np.concatenate([v[:5], v[:3] + 7])
    possible = cells.possible(packed, centers)
    d = clusters.distances(v, centers)
    assert possible[np.arange(200), d.argmin(axis=1)].all() and (bits == 1 or not possible.all())
    best, least = clusters._nearest(v, possible, centers)
    assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


# phrases


def _phrases(rows, least, keep=80, top=2000):
    """The contract, phrase by phrase, for (text, lang) rows."""
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                f[lang or "und"].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inside[p[k : k + size]] = max(inside[p[k : k + size]], a)
        own = []
        for p, a in candidates.items():
            if 100 * inside[p] >= keep * a:
                continue
            score, _, l, r = min((math.floor(Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]])), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def _found(df):
    return sorted(tuple(r[n] for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("least", "block_bytes", "top"), [(3, 8 << 20, 2000), (2, 3000, 40)])
def test_phrases_equal_brute_force(spark, docs_dir, least, block_bytes, top):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert _found(phrases.collocations(docs, least=least, block_bytes=block_bytes, top=top)) == _phrases(rows, least, top=top)


def test_phrases_at_the_edges(spark):
    passage = " ".join(f"w{k}" for k in range(70))
    rows = [(passage, "en")] * 5 + [(None, "en"), ("", None), ("a a a a a a a a", None), ("a\tb a b. a b\x0bA B\x85a B", None), ("x y z " * 40, "fr"), ("日 本 日 本 日 本. 日 本", "ja"), ("\x1c x\x1c   b", None), (passage + " end " + passage, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "'w' AS word", "2 AS w1")
    for least in (1, 3):
        assert _found(phrases.collocations(df, least=least, top=None)) == _phrases(rows, least, top=10**6)
    assert phrases.collocations(df.where("text = ''")).count() == 0


def test_unary_edges_become_paths(spark):
    nodes = [(k, k + 1, k + 2, 9) for k in range(1, 40)] + [(100, 101, 102, 5), (101, 102, 103, 4), (7, 7, 7, 6)]
    edges = [(k, k + 1, k + 2, k + 3, 9, 9) for k in range(1, 39) if k != 20] + [(20, 21, 22, 23, 8, 9), (100, 101, 102, 103, 4, 5), (7, 7, 7, 7, 5, 6)]
    chains, branches = phrases.paths(spark.createDataFrame(nodes, "w1 long, w2 long, w3 long, f long"), spark.createDataFrame(edges, "w1 long, w2 long, w3 long, w4 long, n long, f long"))
    assert sorted((r.words, r.f) for r in chains.collect()) == [([*range(1, 23)], 9), ([7, 7, 7], 6), ([*range(21, 42)], 9), ([100, 101, 102], 5), ([101, 102, 103], 4)]
    assert sorted(map(tuple, branches.collect())) == [(7, 7, 7, 7, 5), (20, 21, 22, 23, 8), (100, 101, 102, 103, 4)]


# pages


def test_field_gradients_equal_finite_differences():
    g = np.random.Generator(np.random.PCG64(3))
    sizes = np.array([4, 1, 6])
    x, y = (g.random((11, 5)) < 0.4).astype(float), g.integers(0, 2, 11)
    chain = crf.Chain({str(k): k for k in range(5)}, 2)
    kinds = g.integers(0, 2, 11)
    parts = [chain.weights, chain.steps, chain.ends]
    for p in parts:
        p[...] = g.normal(size=p.shape)
    x[:, 0] = 1
    rows = crf.Rows([np.flatnonzero(r).tolist() for r in x], 5)
    assert abs(chain.loss(rows, y, sizes, 0.3, kinds)[0] - chain.loss(x, y, sizes, 0.3, kinds)[0]) < 1e-9
    _, gradients = chain.loss(rows, y, sizes, 0.3, kinds)
    for p, grad in zip(parts, gradients):
        for at in np.ndindex(p.shape):
            old, h = p[at], 1e-5
            p[at] = old + h
            up = chain.loss(x, y, sizes, 0.3, kinds)[0]
            p[at] = old - h
            down = chain.loss(x, y, sizes, 0.3, kinds)[0]
            p[at] = old
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-5


def test_field_loss_and_viterbi_equal_all_paths():
    g = np.random.Generator(np.random.PCG64(4))
    for n in range(1, 8):
        x, y = g.normal(size=(n, 3)), g.integers(0, 2, n)
        chain, kinds = crf.Chain({str(k): k for k in range(3)}, 3), g.integers(0, 3, n)
        chain.weights, chain.steps, chain.ends = g.normal(size=3), g.normal(size=(3, 2, 2)), g.normal(size=2)
        own = x @ chain.weights

        def worth(path, own=own, c=chain, kinds=kinds):
            return sum(s for s, p in zip(own, path) if p) + sum(c.steps[k, a, b] for k, (a, b) in zip(kinds[1:], itertools.pairwise(path))) + c.ends[0] * path[0] + c.ends[1] * path[-1]

        every = list(itertools.product((0, 1), repeat=n))
        assert abs(math.log(sum(math.exp(worth(p)) for p in every)) - worth(tuple(y)) - chain.loss(x, y, np.array([n]), 0.0, kinds)[0]) < 1e-9
        assert tuple(crf.viterbi(own.tolist(), chain.steps.tolist(), chain.ends.tolist(), kinds.tolist())) == max(every, key=worth)
    assert crf.viterbi([], [[0, 0], [0, 0]], [0, 0]) == []


def test_blocks_of_broken_pages():
    read = lambda page: [b.text for b in Reader().blocks(page)]
    assert read("<p><b>a<br>b<p>c<i>d</i>e&amp;&lt;&nbsp; f") == ["a b", "cde&< f"]
    assert read("<title>t</title><script>if (a</p>b) '</p>'</script><style>x</STYLE >y") == ["y"]
    assert read("a<!-- <p>x --> b<!-- never closed <p>z") == ["a b"]
    assert read("1 < 2 <3 <p a='>' b=\">\">q</p></div></p>r") == ["1 < 2 <3", "q", "r"]
    assert read('<p>x<a href="y>z</p>w') == ["xz", "w"] and read("x<p y") == ["x"]
    assert read("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert read("<head><title>x</title>stray<p>body") == ["body"] and read("<svg/>a<template>b</template>c") == ["a", "c"]
    (block,) = Reader().blocks('<div class="siteHeader x_menus"><a href=x>abcd</a> efgh</div>')
    assert block.around == {"<div", "~site", "~header", "~x", "~menu"} and block.parent == "div" and abs(block.linked - 4 / 9) < 1e-9
    deep = 200_000
    assert read("<div>" * deep + "x" + "</div>" * deep + "y") == ["x", "y"] and read("<a '" * deep) == []


def _article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    return " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner) if x.strip())


def test_main_text_of_the_tables_pages(spark, docs_dir):
    pages = spark.read.parquet(f"{docs_dir}/pages.parquet")
    wanted = {r.page_id: _article(r.html) for r in pages.where("page_id < 900").collect()}
    got = extraction.extract(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 900} == wanted and all(r.n_chars == len(r.text) for r in got)
    assert len(got) == pages.count() and {(r.page_id, r.url, r.text) for r in got} >= {(902, None, ""), (None, "u", "")}


def test_main_text_of_held_out_layouts():
    extractor = extraction.Extractor(extraction.network())
    right = wrong = missed = 0
    for page in extraction.labelled(page_samples.pages(150, 4711)):
        for got, (_, label) in zip(extractor.labels([b for b, _ in page]), page):
            right, wrong, missed = right + (got & label), wrong + (got & ~label & 1), missed + (label & ~got & 1)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.98


def test_main_text_without_the_rest():
    page = """<body><div class="cookie-notice"><p>We use cookies, as all do. Read on.</p></div><header class="masthead"><a href="/">Daily</a><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav></header>
    <main><article><h1>A title</h1><p>The first part, with <a href=x>a link</a> in it, goes on for a while and then some more.</p><aside class="advert">Buy this now, it is cheap.</aside>
    <p>The second part is about as long as the first was, and it ends here.</p><ul><li>One item of the list, in words.</li></ul></article>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with a word of it, and never did.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><p><a href=z>Another story</a></p></aside><form class="newsletter"><label>Your address</label><button>Send</button></form><footer>&copy; 2020 Daily</footer>"""
    assert extraction.Extractor(extraction.network()).text(page) == (
        "A title The first part, with a link in it, goes on for a while and then some more. The second part is about as long as the first was, and it ends here. One item of the list, in words."
    )
