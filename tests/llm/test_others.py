"""Chat formatting, URL filters, nearest vectors and the pipeline."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from geotrail.llm import chat, hnsw, queries, url_filters

pieces = st.one_of(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "\n", " [/INST]"]), st.text(max_size=3))
strings = st.lists(pieces, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), strings), strings), max_size=5))
def test_turns_read_back(messages):
    out, before = "", []
    for role, text in messages:
        piece, rewrites, a, b = chat.locate_turn(chat.turn_template, before, (role, text))
        assert not rewrites and chat.read_turn(piece) == (role, text) and chat.unescape(piece[a:b]) == text
        assert len(chat.CONTROL.findall(piece)) == (4 if role == "user" else 2)
        out, before = out + piece, [*before, (role, text)]
    assert out == chat.turn_template(messages)


def test_rewritten_history_is_found(spark):
    def forgets_thoughts(messages):
        """A template that takes the thoughts out of all turns but the last."""
        last = len(messages) - 1
        return "".join(f"<{r}>{t if k == last else re.sub('<think>.*?</think>', '', t)}</{r}>" for k, (r, t) in enumerate(messages))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>x</think>a"), (1, 2, "user", "r"), (2, 0, "user", "plain"), (2, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["position"]): r["rewrites"] for r in chat.format_turns(table, forgets_thoughts, context=None).collect()}
    assert got == {(1, 0): False, (1, 1): False, (1, 2): True, (2, 0): False, (2, 1): False}


def test_prefixes_are_rendered_by_default(spark):
    def begins_once(messages):
        """A template with a begin mark and without the thoughts of earlier turns."""
        last = len(messages) - 1
        return "^" + "".join(f"<{r}>{t if k == last else re.sub('<think>.*?</think>', '', t)}</{r}>" for k, (r, t) in enumerate(messages))

    turns = [("user", "q"), ("assistant", "<think>x</think>a"), ("user", "r"), ("assistant", "s")]
    table = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_turns(table, begins_once).collect(), key=lambda r: r["position"])
    for k, r in enumerate(got):
        earlier, now = begins_once(turns[:k]), begins_once(turns[: k + 1])
        shared = len(os.path.commonprefix([earlier, now]))
        assert (r["piece"], r["start"], r["rewrites"]) == (now[shared:], shared, shared < len(earlier))
    assert [r["rewrites"] for r in got] == [False, False, True, False]


@pytest.mark.parametrize("turns", [3, 4, 5, 9])
def test_rewrites_far_back_are_found_by_doubling(spark, turns):
    def summarizes(messages):
        """Texts more than three turns back become one letter."""
        return "".join(f"<{r}>{t if k > len(messages) - 4 else t[:1]}</{r}>" for k, (r, t) in enumerate(messages))

    rows = [(c, k, ("user", "assistant")[k % 2], f"text {c} {k}" if c else "x") for c in range(3) for k in range(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "position", "piece", "start", "rewrites", "text_start", "text_end"]
    by = lambda how: sorted(tuple(r[c] for c in columns) for r in chat.format_turns(table, summarizes, context=how).collect())
    assert by("doubling") == by(None)
    assert any(r[4] for r in by("doubling")) == (turns > 3) and not any(r[4] for r in by("doubling") if not r[0])
    with pytest.raises(ValueError):
        chat.format_turns(table, context="all")


chat_format = chat.format_turns


def test_query_compares_outputs(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(chat, "format_turns", lambda rows, **how: asked.append(how.get("context")) or chat_format(rows, **how))
    queries.op5_chat(spark, sf_dir)
    assert asked == ["doubling"]


def digests(rows):
    turns = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in turns if r[0] == c]
        whole, loss = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.turn_template([(r, x) for *_, r, x in own])))
    return out


def test_conversations(spark, sf_dir):
    rows = [(1, 1, "assistant", "</s>é"), (1, 0, "user", "hi"), (1, 1, "assistant", "</s>é"), (None, None, None, None), (None, 3, "assistant", "x"), (5, 0, "a\nb", "")]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn int, role string, text string, piece int")
    for context in ("doubling", 1, 0):
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest_turns(chat.format_turns(table, context=context)).collect()}
        assert got == digests(rows)
    assert chat.digest_turns(chat.format_turns(table.limit(0))).collect() == []
    given_rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op5_chat(spark, sf_dir).collect()}
    assert got == digests([*given_rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)])


def test_sql_of_registered_queries(spark, sf_dir):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        columns = ", ".join(got.columns)
        want = con.execute(f"SELECT {columns} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_lists_hold_at_the_day_of_the_fetch(spark):
    history = [
        ("a", "host:x.example.com", 10, True),
        ("a", "host:x.example.com", 20, False),
        ("a", "host:x.example.com", 500, True),
        ("b", "domain:example.com", 15, True),
        ("c", "prefix:x.example.com/ads", 0, True),
        ("c", "prefix:x.example.com/ads", 0, True),
        ("d", "host:y.org", 5, True),
        ("d", "host:y.org", 5, False),
        (None, "host:y.org", 5, True),
        ("e", None, 5, True),
        ("f", "host:y.org", None, True),
    ]
    captures = [
        (1, "HTTP://u:p@X.example.com:80/Ads/1", 12),
        (2, "http://x.example.com/ads/1?q", 12),
        (3, "http://x.example.com/ads", 30),
        (4, "http://x.example.com/adsense", 20),
        (5, "https://y.org", 100),
        (6, None, 100),
        (7, "not a url", 100),
        (8, "http://x.example.com/", None),
        (9, "http://deep.x.example.com/ads", 9000),
        (9, "http://deep.x.example.com/ads", 9000),
        (10, "http://x.example.com/", 9000),
        (11, "http://example.com", 15),
        (12, "http://notexample.com", 15),
    ]
    table = spark.createDataFrame([(*c, "kept", 3) for c in captures], "page_id long, url string, day long, _url string, lists int")
    intervals = url_filters.validity(spark.createDataFrame(history, "list string, key string, day long, active boolean"))
    got = sorted((r["page_id"], r["blocked"], r["n_entries"], r["lists"]) for r in url_filters.filter_urls(table, intervals).collect())
    listed = {1: "a", 2: "a,c", 3: "b,c", 4: "b", 9: "b", 10: "a,b", 11: "b"}
    assert got == sorted((c[0], c[0] in listed, len(listed.get(c[0], "").split(",")) if c[0] in listed else 0, listed.get(c[0], "")) for c in captures)
    assert url_filters.filter_urls(table.limit(0), intervals).collect() == []
    assert {r["blocked"] for r in url_filters.filter_urls(table, intervals.limit(0)).collect()} == {False}


def exact_nearest(rows, asks, k):
    out = {}
    for q, a in rows:
        if asks(q):
            scored = sorted(((-float(np.dot(a, b)), i) for i, b in rows if i != q))[:k]
            out[q] = [i for _, i in scored]
    return out


def test_nearest_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1))
    vectors[100:160] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [1.0] * 6), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [1.0]), (1020, []), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, score int")
    got = hnsw.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_rows=150, block=7).toPandas()
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    assert set(got["query_id"]) == set(want)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], [np.dot(vectors[q], vectors[i]) for i in own["vec_id"]])
        keys = list(zip(-own["score"], own["vec_id"], strict=True))
        assert keys == sorted(keys)
        hits += len(set(own["vec_id"]) & set(want[q]))
    assert hits >= 0.98 * 20 * len(want)


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = hnsw.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert hnsw.nearest(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert hnsw.nearest(few, F.lit(None).cast("boolean")).collect() == []


def test_recall_against_brute_force(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    rows = [(r[0], np.array(r[1], float)) for r in spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    table = spark.read.parquet(f"{big}/embeddings.parquet")
    got = hnsw.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=500).groupBy("query_id").agg(F.collect_list("vec_id")).collect()
    assert sum(len(set(ids) & set(want[q])) for q, ids in got) >= 0.95 * 20 * len(want)


def clustered(count, cells, dim=16, noise=0.05):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(cells, dim))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    return middle[rng.integers(0, cells, count)] + noise * rng.normal(size=(count, dim))


def test_bounds_of_cells_hold_and_pass_over_far_ones():
    points = clustered(3000, 24)
    centres = hnsw.fit_centres(points, 24)
    cell, distance = hnsw.nearest_centre(points, centres)
    top = lambda values: np.array([values[cell == c].max(initial=0) for c in range(24)])
    held = np.bincount(cell, minlength=24)
    cells = hnsw.Cells(centres, top(distance), top(np.linalg.norm(points, axis=1)), -(-held // 50))
    assert (held > 0).all() and sorted(np.concatenate([cells.shards_of([c]) for c in range(24)])) == list(range(cells.shards.sum()))
    products = points[::20] @ points.T
    best = np.stack([products[:, cell == c].max(1) for c in range(24)], 1)
    assert (cells.bounds(points[::20]) >= best).all()
    needed = np.sort(products, 1)[:, -21]
    assert (cells.bounds(points[::20]) >= needed[:, None]).sum(1).mean() < 8
    # a cell whose points all lie in one place, fewer places than cells, lone points
    same = np.ones((40, 3))
    assert (hnsw.nearest_centre(same, hnsw.fit_centres(same, 4))[1] == 0).all()


def test_nearest_over_many_cells(spark):
    vectors = clustered(3000, 24)
    rows = list(enumerate(vectors))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>")
    got = hnsw.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=120, block=9).groupBy("query_id").agg(F.collect_list("vec_id")).collect()
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    assert {q for q, _ in got} == set(want) and all(len(ids) == 20 for _, ids in got)
    assert sum(len(set(ids) & set(want[q])) for q, ids in got) >= 0.98 * 20 * len(want)


def test_registered_search_over_several_shards(spark, tmp_path):
    vectors = np.random.default_rng(8).normal(size=(12_000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op4_nearest(spark, str(tmp_path)).groupBy("query_id").agg(F.collect_list("vec_id")).collect()
    products = vectors[::20] @ vectors.T
    products[np.arange(600), np.arange(600) * 20] = -np.inf
    want = np.argsort(-products, axis=1)[:, :20]
    assert len(got) == 600
    assert sum(len(set(ids) & set(want[q // 20])) for q, ids in got) >= 0.95 * 20 * 600


@pytest.fixture(scope="module")
def odd_documents(spark):
    line = " ".join(f"shared{k}" for k in range(60))
    rows = [
        (1, "alpha " + line, "en"),
        (2, "beta gamma " + line + " delta", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, "12 34", "en"),
        (6, line, "en"),
        (6, line, "en"),
        (7, "quite another text", None),
        (7, "quite another text of this id", None),
        (None, "a text without an id", "en"),
    ]
    return spark.createDataFrame([(*r, "s", 5, "x", [1]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_text string, leaks array<int>")


def test_stages_on_odd_rows(spark, sf_dir, odd_documents):
    for docs in (odd_documents, odd_documents.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, odd_documents, sf_dir)
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "2", "6", "6", "7", "7", "None"]
    assert {r["lang"] for r in kept.collect()} == {"en"}
    one = stages["n-gram Jaccard join"](spark, odd_documents, sf_dir)
    assert sorted((str(r["doc_id"]) for r in one.collect())) == ["1", "3", "4", "5", "7", "None"]
    cut = {r["doc_id"]: r for r in stages["substring dedup"](spark, odd_documents, sf_dir).collect()}
    assert cut[2]["text"].split() == ["beta", "gamma", "delta"] and cut[2]["n_chars"] == len(cut[2]["text"]) and 6 not in cut
    assert cut[1]["n_chars"] == 5 and cut[1]["kept_text"] == "x"


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaky = {r["doc_id"] for r in queries.op9_decontamination(spark, sf_dir).collect()}
    classes = {r["doc_id"]: r["class_id"] for r in queries.op3_jaccard_join(spark, sf_dir).collect()}
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    kept = set(packed["doc_id"])
    repeats = {r["doc_id"]: r["n_removed"] for r in queries.op8_substring_dedup(spark, sf_dir).collect()}
    assert kept and all(classes[d] == d for d in kept) and all(repeats[d] for d in kept & leaky)
    lost = {r["doc_id"] for r in docs.select("doc_id").collect()} - kept - leaky - {d for d, c in classes.items() if d != c}
    assert all(repeats[d] for d in lost)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 1024
