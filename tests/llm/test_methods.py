"""Runs, lexical search, vector graphs, filled mixes, long conversations, and the pipeline's stages on edge cases."""

from __future__ import annotations

import math
import os
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import chat, lexical_search, mixing, ngram_join, run_detection, vector_graph
from tracelake.llm import bytetext as B
from tracelake.llm.registry import oracles, queries

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, _id long, _tag long, _host string, __tl_id long, __tl_tag long, __tl_host string, kept string, component long, size long, term string, runs string"


def prose(seed: int, n: int, words: int = 500) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, words, n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (1, prose(1, 300)), (2, prose(1, 300)), (3, None), (4, ""), (5, " \n\t"), (6, "One two ONE"), (None, prose(2, 80)), (None, prose(3, 80)), (7, "ab " * 400), (8, "x y z x y z x y z x y z w"),
        (9, prose(4, 4000)), (9, prose(4, 4000)), (10, "été Été ÉTÉ naïve"), (11, "a-b_c.d/1 2"), (12, prose(5, 30) + (" same line again" * 9)),
    ]
    rows = [(i, t, None, [None, "a", "b"][k % 3], 0, "r", "k", 1, 2, "h", 3, 4, "t", "x", 5, 6, "m", "n") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3).cache()


def against_sql(name: str, got, **tables) -> None:
    con = duckdb.connect()
    for k, df in tables.items():
        con.register(k, df.toArrow())
    want = con.sql(oracles()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(got.select(*cols).collect()) == show(con.sql(f"SELECT {', '.join(cols)} FROM ({oracles()[name]})").fetchall())


# Runs


def plain_runs(words: list, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """Every period, every stretch."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in out.items())


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 8)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4), st.integers(3, 5), st.integers(6, 9))
def test_runs_are_all_runs(texts, exponent, shortest):
    words = [[f"w{x}" for part, n in t for x in part * n] for t in texts]
    words = [w + w[2:] if k % 2 else w for k, w in enumerate(words)]  # a text that copies its own runs
    raw = [" ".join(w).encode() for w in words]
    n, found, collapsed = run_detection._piece(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), exponent, shortest)
    for w, count, runs, text in zip(words, n, found.to_pylist(), collapsed.to_pylist()):
        want = plain_runs(w, exponent, shortest)
        assert count == len(w) and [(r["start"], r["period"], r["start"] + r["length"]) for r in runs] == want
        gone = {i for s, q, e in want for i in range(s + q, e)}
        assert text == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_words_with_one_hash(monkeypatch):
    """Words are told apart by both hashes."""
    first = np.zeros(8, dtype=np.uint64)
    second = np.array([1, 2] * 4, dtype=np.uint64)
    s = run_detection.Suffixes(first, second, np.zeros(8, dtype=np.int64), np.full(8, 8, dtype=np.int64))
    assert run_detection.all_runs(s).tolist() == [[0, 8, 2]]


def test_runs(spark, docs):
    given_ = docs.withColumn("doc_id", F.col("doc_id"))
    against_sql("op11_run_detection", run_detection_query(docs), documents=docs.select("doc_id", "text").where("doc_id is not null"))
    assert run_detection.find_runs(docs.where("false")).count() == 0
    rows = {r.doc_id: r for r in run_detection.find_runs(given_).collect()}
    assert rows[3].n_words == 0 and rows[3].collapsed == "" and rows[3].runs == []
    assert [tuple(x) for x in rows[7].runs] == [(0, 400, 1)] and rows[7].collapsed == "ab"
    assert [tuple(x) for x in rows[8].runs] == [(0, 12, 3)] and rows[8].collapsed == "x y z w"
    with pytest.raises(ValueError):
        run_detection.find_runs(docs, exponent=2)


def run_detection_query(docs):
    """The query's columns over other rows."""
    real = run_detection.table
    run_detection.table = lambda *a: docs.where("doc_id is not null")
    try:
        return run_detection.op11_run_detection(docs.sparkSession, "")
    finally:
        run_detection.table = real


# Lexical search


ITEMS = [(0, "w1 W2 w3 w3"), (1, "ONE"), (2, "naïve été"), (3, None), (4, "..."), (5, "nowhere"), (0, "w1 W2 w3 w3"), (0, "b_c 2 D")]


@pytest.mark.parametrize("block, shard", [(512, 8 << 20), (2, 8 << 20), (3, 2_000)])
def test_lexical_search(spark, docs, monkeypatch, block, shard):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = lexical_search.LexicalIndex.build(docs, shard_bytes=shard)
    got = index.search(items)
    # An item_id with two texts has two lists, which the SQL would merge.
    one = items.where("item_id > 0")
    against_sql("op12_lexical_search", index.search(one), documents=docs.select("doc_id", "text"), benchmark=one)
    assert [r["rank"] for r in got.where("item_id = 0").collect()].count(1) == 2
    assert got.where("item_id in (3, 4, 5)").count() == 0
    assert lexical_search.LexicalIndex.build(docs.where("false")).search(items).count() == 0
    assert index.search(items.where("false")).count() == 0
    index.drop()


def test_lexical_index_grows(spark, docs, tmp_path):
    path, items = str(tmp_path / "index"), spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    half = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    index = lexical_search.LexicalIndex.build(docs.where(half), path)
    kept = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(path) for p in names if p.endswith(".parquet")}
    index = index.add(docs.where(~half))
    files = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(path) for p in names if p.endswith(".parquet")}
    assert kept.items() <= files.items() and len(files) > len(kept)
    again = lexical_search.LexicalIndex.open(spark, path).search(items, top=4)
    whole = lexical_search.LexicalIndex.build(docs).search(items, top=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_merge_passes_blocks_over(monkeypatch):
    """Blocks that cannot enter the heap are not scored; the result is that of all scores."""
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    r = np.random.default_rng(2)
    for _ in range(50):
        n, lists, bounds, every = 40, [], [], np.zeros(40, dtype=np.int64)
        for _ in range(3):
            doc = np.flatnonzero(r.random(n) < 0.5)
            part, weight = r.integers(0, 9, len(doc)), int(r.integers(1, 4))
            every[doc] += weight * part
            block, count = np.unique(doc // 4, return_counts=True)
            lists.append((weight, block.tolist(), np.cumsum(count).tolist(), doc, part))
            bounds.append([part[doc // 4 == b].max() for b in block])
        want = sorted(((-s, d) for d, s in enumerate(every) if s > 0))[:5]
        assert sorted(((-s, d) for s, d in lexical_search.merge(lists, bounds, 5, None))) == want


def test_varints():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 2**28, 2**35 - 1, 2**40])
    raw, size = lexical_search.varints(v)
    assert len(raw) == size.sum() and (lexical_search.from_varints(raw) == v).all()


# Vector graphs


def nearest(rows, queries_, k):
    """Brute force: query -> (vec_id, cosine)."""
    out = {}
    for q, v in queries_:
        v = np.asarray(v, dtype=np.float64)
        found = []
        for i, w in rows:
            w = np.asarray(w, dtype=np.float64)
            if i != q and len(w) == len(v):
                found.append((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i))
        out[q] = sorted(found)[:k]
    return out


def test_vector_graph(spark):
    """Copies, near copies, scaled copies, two dimensions; vectors that take no part; clashing names."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]
    x[300:400] = x[100] + r.normal(size=(100, 8)).astype(np.float32) * 1e-3
    x[400:410] = x[0] * 2
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(1000 + i, [float(y) for y in v[:3]]) for i, v in enumerate(x[:7])]
    odd = [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0, None] * 4), (2200, [float("nan")] * 8), (2250, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), rows[0]]
    t = spark.createDataFrame([(*row, 1, 2) for row in rows + odd], "vec_id long, embedding array<float>, shard int, vector int").repartition(5)
    index = vector_graph.VectorIndex.build(t, shard_nodes=150)
    out = index.search(t.where(F.col("vec_id") % 50 == 0))
    got: dict = {}
    for row in out.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    want = nearest(rows, [x for x in rows if x[0] % 50 == 0], 5)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert len(got[q]) == len(best)
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and q not in dict(got[q])
        hits += sum(abs(-w[0] - g[1]) < 1e-12 for w, g in zip(best, got[q]))
    assert hits >= 0.98 * sum(map(len, want.values()))
    # Copies: the smallest ids.
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert vector_graph.VectorIndex.build(t.where("false")).search(t).count() == 0
    assert index.search(t.where("vec_id = 2100")).count() == 0
    index.drop()


def test_vector_query_recall(spark, tmp_path):
    """The query against brute force, and an index that was written and reopened."""
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    want = nearest(rows, [x for x in rows if x[0] % 50 == 0], 5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries()["op13_vector_graph"](spark, SF).collect()}
    assert len(got) == 5 * len(want)
    good = sum(got[q, k + 1][0] == i and abs(got[q, k + 1][1] + s) < 1e-12 for q, best in want.items() for k, (s, i) in enumerate(best))
    assert good >= 0.9 * len(got)
    path = str(tmp_path / "graph")
    vector_graph.VectorIndex.build(t, path)
    again = vector_graph.VectorIndex.open(spark, path).search(t.where("vec_id % 50 = 0"), top=3)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in again.collect()} == {k: v for k, v in got.items() if k[1] <= 3}


def test_graph_reaches_every_node():
    """Thousands of near copies and a few others: all nodes are reached, and searches find the nearest."""
    r = np.random.default_rng(5)
    x = vector_graph.unit(np.concatenate([np.ones((700, 16)) + r.normal(size=(700, 16)) * 1e-4, r.normal(size=(300, 16))]))
    edges, entries = vector_graph.graph(x)
    seen = np.zeros(len(x), dtype=bool)
    now = entries
    while len(now):
        seen[now] = True
        now = np.unique(edges[now])
        now = now[now >= 0]
        now = now[~seen[now]]
    assert seen.all() and edges.shape == (1000, vector_graph.DEGREE)
    found = vector_graph.beam(x, edges, entries, x, 32)
    assert (found[:, 0] == np.arange(1000)).mean() > 0.95


# Mixing


def test_mix_fills_capped_sources(spark):
    """A source that is to give twice its size gives it whole, whatever its sizes; the others come within half a text."""
    rows = [(k, "a" if k % 2 else None, ("a " * (20 if k % 3 else 3_000)).strip()) for k in range(400)] + [(1000 + k, "big", "b " * (700 + 37 * k)) for k in range(120)] + [(None, "a", f"no id {k} " * 30) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs).toPandas()
    for source, part in out.groupby("source", dropna=False):
        target, largest = part.target.iloc[0], part["size"].max()
        assert abs(part.taken.sum() - target) <= largest / 2 + 1, source
        assert (part.taken <= 2 * part["size"]).all()
        if target == 2 * part.source_size.iloc[0]:
            assert part.taken.sum() == target
    assert (out.groupby("source", dropna=False).target.first() == 2 * out.groupby("source", dropna=False).source_size.first()).any()
    # Rows without doc_id are told apart by their texts.
    few = mixing.mix(docs.where("doc_id is null"), share_percent=50).toPandas()
    assert set(few.copies) == {0, 1} and abs(few.taken.sum() - few.target.iloc[0]) <= 60


def test_mix_by_sql_where_some_texts_are_full(spark):
    rows = [(k, "abcd"[k % 4] if k % 9 else None, "x " * (1 + (k * k) % (2 if k % 4 == 1 else 900))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for share in (150,):
        against_sql("op2_mixing", mixing.mix(docs, share_percent=share).select("doc_id", "size", "source_size", "target", "taken"), documents=docs)


# Chat


def test_long_conversation_is_read_in_linear_time(spark):
    def took(n: int) -> float:
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("some <text> "), 50).alias("text"))
        out = chat.format_rows(rows)
        began = time.time()
        got = out.select(chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("l"), F.size(chat.read_turns(F.col("formatted"))).alias("n")).first()
        assert got.n == n and got.l == "some <text> " * 50 * (n // 2)
        return time.time() - began

    took(1000)
    assert took(8000) < 5


def test_layout_goes_by_fingerprint(spark, monkeypatch):
    """The plan holds the map from fingerprints, and the choice hangs on the hash alone."""
    df = spark.createDataFrame([('{"prompt": "q", "completion": "a"}',)], "j string").select(F.parse_json("j").alias("record"))
    assert chat.canonical(df, "record").first().layout == "prompt and completion"
    monkeypatch.setattr(chat, "fingerprints", lambda own: F.array(*[F.lit(7).cast("bigint")] * len(chat.LAYOUTS)))
    assert chat.canonical(df, "record").first().layout is None


# Pipeline


def test_pipeline_stages_on_edge_cases(spark, docs, tmp_path):
    """Clashing names, null ids and texts, repeated rows, an empty table: no crash, all columns kept, decisions as without them."""
    for name in ("benchmark", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(20 if name == "benchmark" else 0).write.parquet(str(tmp_path / f"{name}.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        key = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
        assert key(got) == key(stage(spark, plain, str(tmp_path))), name
        assert got.where("_host <> 'h' or `__tl_id` <> 3").count() == 0
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op2_mixing", "op4_chat_format", "op11_run_detection", "op12_lexical_search"])
def test_queries_of_whole_tables_against_sql(spark, name):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark", "conversations")}
    against_sql(name, queries()[name](spark, SF), **tables)


def test_settled_lists_leave(spark, monkeypatch):
    """Lists of two sets are gone after their pivot's round, and are not looked up again."""
    seen = []
    whole = ngram_join.materialize

    def counted(df, name):
        out = whole(df, name)
        if name == "live":
            seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    monkeypatch.setattr(ngram_join, "PAIRS_AN_ENTRY", 0)
    texts = []
    for k in range(20):  # two texts that share their first half alone, and two that are alike
        half = [f"h{k}w{i}" for i in range(10)]
        texts += [" ".join(half + [f"a{k}w{i}" for i in range(10)]), " ".join(half + [f"b{k}w{i}" for i in range(10)])]
        alike = [f"c{k}w{i}" for i in range(60)]
        texts += [" ".join(alike), " ".join(alike[:59] + ["else"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: i - (i % 4 == 3) for i in range(len(texts))}
    assert seen and sum(seen) == 0
