"""URL rules and top-k search against brute force; components; the SQL of the registered queries; the pipeline."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from edge import text_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from txnflow.llm import topk_search, unionfind, url_rules

SF = "/root/testdata/sf0.001"

# URL rules ------------------------------------------------------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("Example.org", "/en/12", "allow"),
         ("com", "", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("b.a.com", "", "block"), (None, "/", "block"),
         ("", "/", "block"), ("net", None, "block"), ("x%y.org", "/%", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES if h and p is not None)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    top = max(fits)[:3]
    return host, path, top[2], min(f[3] for f in fits if f[:3] == top)


def test_url_rules(spark):
    rng = random.Random(4)
    hosts = ["example.org", "www.EXAMPLE.org", "org", "org.", ".org", "a.com", "b.a.com", "c.b.a.com", "ba.com", "com", "net", "x.net", "", "x%y.org",
             "example.org:80", "exämple.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/x", "/xy?q=/es/", "?a#b", "#/es/", "/%", "/é\n/x"]
    urls = [None, "", "no scheme", "://", "a://b://c", "http:/one"] + [rng.choice(["http", "", "HTTPS"]) + "://" + rng.choice(hosts) + rng.choice(paths)
                                                                  for _ in range(300)]
    pages = spark.createDataFrame([(n % 40, u, "r") for n, u in enumerate(urls + urls[:50])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules)
    assert sorted(got.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    want = [(n % 40, u, *judged(u)) for n, u in enumerate(urls + urls[:50])]
    key = lambda r: tuple(map(repr, r))
    assert sorted(got.select("page_id", "url", "host", "path", "rule", "verdict").collect(), key=key) == sorted(want, key=key)
    assert url_rules.judge_urls(pages.where("false"), rules).collect() == []
    assert {r.rule for r in url_rules.judge_urls(pages, rules.where("false"), otherwise="block").collect()} == {None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# top-k search -----------------------------------------------------------------------------------------------------------

def best(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q is None or q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i) for i, w in ok if i != q)
        out |= {(q, n + 1, None if i == math.inf else i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block,chunk", [(4096, 1024), (64, 16)])
def test_topk_search(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "CHUNK", chunk)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    gen = np.random.default_rng(2)
    rows = [(n, (gen.normal(size=6) * gen.choice([0.1, 1, 3])).astype(np.float32).tolist()) for n in range(0, 900, 3)]
    rows += [(n, rows[5][1]) for n in range(2000, 2060)]                                 # ties
    rows += [(7, None), (8, [None] * 6), (800, [1.0, float("nan")] + [0.0] * 4), (10, [float("inf")] * 6), (None, rows[0][1]), (100, []), (5000, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = topk_search.search(vectors, F.col("vec_id") % 100 == 0, k=10).collect()
    assert {tuple(r) for r in got} == best(rows, 10) and len(got) == len(set(map(tuple, got)))


def test_topk_search_of_few_large_and_none(spark):
    vectors = spark.createDataFrame([(0, [1e13, 1.0]), (1, [1e13, -1.0]), (2, [-1e13, 0.5]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = topk_search.search(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2 ** 63 - 1), (3, 0), (2, -2 ** 63)]
    assert topk_search.search(vectors.where("vec_id > 0"), F.col("vec_id") % 100 == 0).collect() == []
    assert topk_search.search(vectors.where("false"), F.col("vec_id") % 100 == 0).collect() == []


# components -------------------------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(6)
    links = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 160)] + [(900 - n, 901 - n) for n in range(30)] \
        + [tuple(sorted(rng.sample(range(1000, 1100), 2))) for _ in range(60)]
    rng.shuffle(links)
    least = {}
    group = {x: {x} for link in links for x in link}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    least = {x: min(g) for x, g in group.items()}
    got = unionfind.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert dict(map(tuple, got)) == {x: m for x, m in least.items() if x != m} and len(got) == len(dict(map(tuple, got)))
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).collect() == []


# registered queries ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return c


ALL = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in ALL) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [q for q in ALL if q in entry.oracle_sql()])
def test_query_equals_its_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in entry.queries()["op6_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in rows) >= 0.98 * len(rows) > 100
    good = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op10_quality"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in rows) >= 0.95 * len(rows) > 50


# pipeline -----------------------------------------------------------------------------------------------------------------

def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on planted rows: what it drops and cuts, and that the rest stays as it was."""
    import corpus_pipeline as cp
    from test_documents_ops import contamination, near_groups, removed_words
    from tokenizers import Tokenizer

    rng = random.Random(11)
    stages = dict(cp.STAGES)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = [text_of(rng, n) for n in (5, 40, 90, 300)]
    passage = " ".join(f"passage{n}" for n in range(60))
    texts = [None, "", *base, base[2], base[3] + " more", "junk " * 80, base[0] + bench[0][1] + " end", f"{base[1]} {passage} one", f"two {passage}",
             passage, *(text_of(rng, 50) for _ in range(20))]
    rows = [(n, t, "en", None, None if t is None else len(t), "x") for n, t in enumerate(texts)] + [(None, base[1], None, "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)
    pairs = [(r[0], r[1]) for r in rows]

    scored = stages["quality_classifier"](spark, docs, SF)
    assert scored.columns == docs.columns and set(scored.collect()) <= set(docs.collect())

    near = stages["minhash_near_dedup"](spark, docs, SF)
    groups = near_groups(pairs, 5)
    assert near.columns == docs.columns
    assert sorted(map(repr, near.select("doc_id", "text").collect())) == sorted(
        repr(r) for r in docs.select("doc_id", "text").collect() if (r.doc_id in {g[0] for g in groups if g[3]}))

    cut = stages["substring_dedup"](spark, docs, SF)
    want = {(i, t if not gone else kept) for (i, t), (n, gone, kept) in zip(pairs, removed_words(pairs, 20)) if gone == 0 or gone < n}
    assert cut.columns == docs.columns and {(r.doc_id, r.text) for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text and r.doc_id is not None)

    clean = stages["benchmark_decontamination"](spark, docs, SF)
    want = {(i, t) for (i, t), c in zip(pairs, contamination(pairs, bench, 10)) if not c[2]}
    assert clean.columns == docs.columns and {(r.doc_id, r.text) for r in clean.collect()} == want and len(want) < len(pairs)

    library = Tokenizer.from_file(cp.public_tokenizers.path(cp.VOCABULARY))
    for r in stages["bpe_encoding"](spark, docs.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id"), SF).collect():
        assert r.n_tokens == len(r.token_ids)
        assert r.decoded == library.decode(r.token_ids, skip_special_tokens=False)

    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == [], name


def test_pipeline_runs(spark):
    import corpus_pipeline as cp
    out = cp.run(spark, SF)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() < given.count() and out.select("doc_id").distinct().count() == out.count()
    assert out.where("n_tokens != size(token_ids)").count() == 0


def test_pipeline_deletes_what_is_consumed(spark, monkeypatch):
    """Of all tables that the stages write, only the last one's output is left."""
    import os
    import corpus_pipeline as cp
    from txnflow.llm.tables import written
    from txnflow.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    helped = lambda s, docs, _: docs.join(written(docs.select("doc_id").where("doc_id % 2 = 0"), "helper"), "doc_id")
    monkeypatch.setattr(cp, "STAGES", [("one", helped), ("two", helped), ("three", lambda s, docs, _: docs.select("doc_id"))])
    before = set(os.listdir(folder))
    out = cp.run(spark, SF)
    assert [d.rsplit("-", 1)[0] for d in set(os.listdir(folder)) - before if not d.startswith(".")] == ["txnflow-three"]
    want = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0").count()
    assert out.count() == want > 0
