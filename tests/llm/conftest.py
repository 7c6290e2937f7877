from __future__ import annotations

import pytest

#: Texts at the edges: nulls, empty and blank ones, ties, special strings, odd blanks, long ones.
PASSAGE = "\n".join(f"line {k} of a passage, which is long enough to matter to every rule here" for k in range(6))
EDGES = [
    (9001, "a b  c <|endoftext|> x  y \n\n Z's  "),
    (9002, None),
    (9003, ""),
    (9004, " \n \t\n\n\n"),
    (9005, "x\x1cy \x85  !! ﻿ q 'LL a b"),
    (9006, "日本語 テスト  ё̈ é ΑΣ ÉÀ İ 😀😀"),
    (9007, "a<|ENDOFTEXT|>"),
    (9008, "<|endoftext|> <|startoftext|>\t\tb"),
    (9009, "x\n" + PASSAGE + "\ny"),
    (9010, PASSAGE),
    (9011, PASSAGE.upper() + " tail"),
    (9012, "a" * 1000),
    (9013, "ab" * 300 + "é" * 250),
    (9014, "solo"),
    (9015, "word of many words in a very long text, " * 5000),
    (None, PASSAGE + "\nq"),
    (None, "zz"),
    (9001, "a second row of one id"),
    (9010, PASSAGE),
    (-3, "neg the the zzq"),
]


@pytest.fixture(scope="session")
def docs_dir(spark, tmp_path_factory):
    """A folder with documents (with columns whose names clash with inner ones), benchmark and labels."""
    at = tmp_path_factory.mktemp("tables")
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in EDGES]
    docs = real.unionByName(spark.createDataFrame(rows, real.schema))
    for name, value in {"block": "1", "kind": "'k'", "fp": "2", "row": "'r'", "id": "3", "removed": "array(1)", "window": "0", "score": "1.0", "part": "7"}.items():
        docs = docs.selectExpr("*", f"{value} AS {name}")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = [(900, "Solo"), (901, "THE the zzq"), (902, None), (903, "..."), (904, "é ΑΣ ÉÀ"), (905, "solo"), (906, PASSAGE)]
    items.unionByName(spark.createDataFrame(more, items.schema)).write.parquet(f"{at}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 90")
    own = [list(r.embedding) for r in vectors.where("vec_id < 3").orderBy("vec_id").collect()]
    odd = [own[0], None, [], own[1][:63], [*own[1], 0.0], [None, *own[1][1:]], [float("nan"), *own[1][1:]], [float("inf"), *own[1][1:]], [0.5] * 64, [0.5] * 64]
    rows = [(k if k % 4 else None, v, 0) for k, v in enumerate(odd, 900)] + [(0, own[0], 0), (0, own[2], 0)]
    vectors = vectors.unionByName(spark.createDataFrame(rows, vectors.schema)).selectExpr("*", "1 AS key", "'c' AS cells", "2 AS cluster", "array(1) AS vector")
    vectors.repartition(3).write.parquet(f"{at}/embeddings.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rows = [(901, "u", None), (902, None, ""), (None, "u", " \n "), (901, "u", "<p>a<p>b"), (903, "u", "no tags at all, and a text that is long enough to be one.")]
    pages.unionByName(spark.createDataFrame(rows, pages.schema)).selectExpr("*", "'t' AS text", "0 AS n_chars").repartition(3).write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.fixture(scope="session")
def texts(spark, docs_dir):
    """(doc_id, text) of all rows, null texts as empty."""
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{docs_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty_dir(spark, docs_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{docs_dir}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)
