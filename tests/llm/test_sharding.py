"""Sharding: shards against sorted rows, groups of copies, odd rows and the plan."""

import hashlib

import pytest
from pyspark.sql import functions as F

from geotrail.llm import queries, sharding

SCHEMA = "doc_id long, text string, lang string, size string, shard int"


def by_sorting(rows, shards):
    """Shards of (doc_id, text) rows: boundaries between the rows nearest to equal shares."""
    size = lambda r: len((r[1] or "").encode()) + 1
    rows = sorted(rows, key=lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0]))
    below = [0]
    for r in rows:
        below.append(below[-1] + size(r))
    cuts = [min(below, key=lambda b: (abs(b - below[-1] * s // shards), b)) for s in range(1, shards)]
    out, slots = {}, [0] * shards
    for r, b in zip(rows, below, strict=False):
        s = sum(c <= b for c in cuts)
        out[r[0]] = (size(r), s, slots[s])
        slots[s] += 1
    return out


def placed(df):
    return {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"part_bytes": 3_000, "probes": 16}, {"part_bytes": 500, "max_parts": 40}])
def test_shards_are_those_of_sorting(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert placed(sharding.shard(docs, 7, **how)) == by_sorting([(r["doc_id"], r["text"]) for r in docs.collect()], 7)


def test_copies_are_split_by_id(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k} " * (k % 50), "en", "x", 9) for k in range(3000)]
    rows += [(10**15 + k * 10**12, "the same text", "en", "x", 9) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(13)
    want = by_sorting([r[:2] for r in rows], 16)
    for how in ({}, {"part_bytes": 400, "probes": 32}):
        out = sharding.shard(table, 16, **how)
        assert placed(out) == want and out.columns == ["doc_id", "text", "lang", "size", "law", "shard", "slot", "grown_shard"]
    size, n = {}, {}
    for s, shard, _ in want.values():
        size[shard], n[shard] = size.get(shard, 0) + s, n.get(shard, 0) + 1
    assert max(size.values()) - min(size.values()) < 2 * max(s for s, *_ in want.values())


def test_tolerance_bounds_the_difference(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    out = sharding.shard(docs, 8, tolerance=0.05, probes=64).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    total = sum(r["b"] for r in out)
    assert len(out) == 8 and all(abs(r["b"] - total / 8) <= 0.1 * total / 8 + 40_000 and r["last"] == r["n"] - 1 for r in out)


def test_odd_rows(spark):
    rows = [(1, None, "a", "s", 0), (2, "", "a", "s", 0), (None, "é" * 10, None, None, None), (None, "é" * 10, "b", None, None)] + [(7, "same", "x", "y", 1)] * 30
    table = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(table, 5).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1} and {r["size"] for r in got if r["doc_id"] is None} == {21}
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    for s in {r["shard"] for r in got}:
        own = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.shard(table.limit(0)).collect() == []
    assert {(r["shard"], r["slot"]) for r in sharding.shard(table.limit(1), 3).collect()} <= {(s, 0) for s in range(3)}
    assert sharding.shard(table, 1).agg(F.max("slot")).first()[0] == len(rows) - 1
    text_ids = table.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert sharding.shard(text_ids, 4).count() == len(rows)
    with pytest.raises(ValueError):
        sharding.shard(table, 0)


def test_one_exchange_and_no_python(spark, sf_dir):
    plan = queries.op11_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
