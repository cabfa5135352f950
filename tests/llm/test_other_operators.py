"""Vectors, urls and the pipeline against brute force."""

import math
import os

import numpy as np
import pytest

from quern.llm import embedding_dedup, url_filter
from quern.llm.hnsw import Graph


def brute(rows, threshold=0.9):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            a = np.array(v, float)
            unit[k] = a / np.linalg.norm(a)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    return sorted((i, n[k], root(i), root(i) == i) for k, (i, _) in enumerate(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(120, 16))
    rows = [(i, (centres[i % 120] + rng.normal(size=16) * (0.05 if i % 3 else 0.45)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 0.0]), (2006, [2.0, 0.1]), (2007, [1e-300] * 16), (2008, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, id long")
    got = embedding_dedup.near_duplicates(df, least_shards=3, query_rows=200)
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vectors_are_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, tight=0.99)
    q = x[::10] + rng.normal(size=(300, 32)).astype(np.float32) * 0.02
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = g.search(q, 48)
    best = np.argmax(q @ g.x.T, axis=1)
    assert (ids == best[:, None]).any(1).mean() > 0.9


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_urls(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "https://A.example.NET/en/x?y#z", ""), (2, "http://a.example.net/fr/", ""), (3, "http://b.org/fr/x", ""), (4, "http://b.org/fr", ""), (5, "http://www.example.com/de/1", ""), (6, None, "x"), (7, "no url", None), (8, "http://net", ""), (9, "x://y.net:80/", ""),
        (10, "http://plain.org/a", link("http://a.example.net/fr/")), (11, "http://mirror.org/b", '<META http-equiv="refresh" content="0; url=http://plain.org/a#f">'), (12, "http://c.org/d/e", link("../f")), (13, "http://k.org/x", link("http://evil.net/y")), (14, "http://l.org/x", link("//k.org/x")), (15, "http://l.org/x", ""), (16, "http://b.org/fr/z", link("/q")), (17, "http://b.org/q", ""), (17, "http://b.org/q", ""), (18, "http://p.org/q", link("http://b.org/fr/z")),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, RULES).collect())
    assert got == [
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/fr/", "net/", "block"), (3, "b.org", "/fr/x", "org/fr/", "allow"), (4, "b.org", "/fr", None, "allow"), (5, "www.example.com", "/de/1", "example.com/de/", "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "net", "", None, "allow"), (9, "y.net:80", "/", None, "allow"), (10, "plain.org", "/a", None, "block"), (11, "mirror.org", "/b", None, "block"), (12, "c.org", "/d/e", None, "allow"),
        (13, "k.org", "/x", None, "block"), (14, "l.org", "/x", None, "block"), (15, "l.org", "/x", None, "block"), (16, "b.org", "/fr/z", "org/fr/", "allow"), (17, "b.org", "/q", None, "allow"), (17, "b.org", "/q", None, "allow"), (18, "p.org", "/q", None, "allow"),
    ]
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0 and url_filter.filter_urls(df, []).where("verdict <> 'allow'").count() == 0


def test_given_redirects(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", ""), (2, "http://b.net/y", "")], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.org/x", "http://b.net/y")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(df, RULES, redirects).collect()} == {1: "block", 2: "block"}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from quern.llm.common import read_table, saved

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] >= 0.95 * read_table(spark, SF, "documents").count()
    from quern.llm import decontaminate, jaccard_join

    assert jaccard_join.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert decontaminate.find_leaks(docs, read_table(spark, SF, "benchmark")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
