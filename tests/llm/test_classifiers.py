"""Language ID and quality: accuracy on rows not learned from, and odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotrail.llm import language_id, quality, queries

ODD = [None, "", "   ", "12 34 !!", "zzz", "é" * 3, "\x00\x01 a"]


def test_code_lengths_by_hand():
    texts = [b"abab", b"aba"]
    counts = language_id.count_contexts(texts, 1, 100, 1).assign(lang="x")
    model = language_id.build_model(counts, 1)
    at = lambda text: model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
    # after a: b three times of 3, one kind, so 3 of 4; after b: a twice of 2, so 2 of 3
    start = -np.log2(2 / 3)
    assert at(b"ab") == pytest.approx(start - np.log2(3 / 4), rel=1e-6)
    assert at(b"aba") == pytest.approx(start - np.log2(3 / 4) - np.log2(2 / 3), rel=1e-6)
    # a after a: an escape (1 of 4), then order 0 without b: 4 of 4 + 1 kind
    assert at(b"aa") == pytest.approx(start + 2 - np.log2(4 / 5), rel=1e-5)


def test_probabilities_sum_to_one():
    counts = language_id.count_contexts([b"the cat sat on the mat", b"that hat"], 3, 50, 1).assign(lang="x")
    model = language_id.build_model(counts, 3)
    for before in (b"", b"t", b"th", b"the", b"q", b"zat"):
        total = 0.0
        for c in range(256):
            text = before + bytes([c])
            bits = [model.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0] if t else 0.0 for t in (text, before)]
            total += 2 ** -(bits[0] - bits[1])
        assert total == pytest.approx(1, rel=1e-4)


def test_models_travel_whole():
    counts = pd.concat([language_id.count_contexts([t], 3, 50, 1).assign(lang=lang) for lang, t in (("x", b"the cat sat on the mat"), ("y", b"die Katze sass"))])
    model = language_id.build_model(counts, 3)
    again = language_id.unpack(language_id.PackedModel(model.languages, language_id.pack(model)))
    assert np.array_equal(model.bits, again.bits) and np.array_equal(model.child, again.child) and again.languages == ["x", "y"]


def test_language_of_held_out_documents(spark, sf_dir):
    got = queries.op2_language_id(spark, sf_dir).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and got["score"].between(0, 1).all()
    assert (both[both["held_out"]]["lang_pred"] == both[both["held_out"]]["lang"]).mean() > 0.97


def test_language_of_odd_rows(spark):
    rows = [(k, t, "en", 1.5) for k, t in enumerate(ODD)] + [(None, "hello there", None, 0.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    teach = spark.createDataFrame([(k, f"hello there my friend {k}", "en") for k in range(9)] + [(k, f"hallo mein freund dort {k}", "de") for k in range(9, 18)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.train(teach))
    assert got.columns.count("score") == 1 and got.count() == 9
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in range(7)] == [True] * 4 + [False] * 3
    assert by_id[None]["lang_pred"] == "en"
    nothing = language_id.train(teach.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), nothing).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("g").alias("g"), F.lit("text").alias("text"))
    from geotrail.llm.sampling import bounded_sample

    kept = bounded_sample(docs, "g", F.col("doc_id"), 50, 10_000, F.length("text"))
    assert 20 < kept.count() <= 50 and kept.columns == docs.columns
    assert bounded_sample(docs, "g", F.col("doc_id"), 50, 40, F.length("text")).count() == 10


def test_long_texts_take_no_place_in_samples(spark):
    import corpus_pipeline
    from geotrail.llm.sampling import bounded_sample

    texts = [(k, "en", f"hello there my friend {k}") for k in range(20)] + [(k, "de", "sehr " * (900 + k)) for k in range(100, 103)]
    texts += [(k, "en", "long " * 2000) for k in range(20, 40)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    kept = {r["doc_id"] for r in bounded_sample(docs, "lang", F.col("doc_id"), 50, 1000, F.length("text")).collect()}
    assert kept == {*range(20), 100}
    assert list(language_id.train(docs, sample_chars=1000).languages) == ["de", "en"]
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 30, 1).otherwise(0).alias("quality"))
    odd = docs.withColumn("doc_id", -F.col("doc_id"))
    model = quality.train(odd, labels.withColumn("doc_id", -F.col("doc_id")), sample_chars=1000)
    assert model.logit.any()
    unknown = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(90, None, "12 !"), (91, None, None)], docs.schema))
    assert corpus_pipeline.identify_language(spark, unknown, "").count() == len(texts)


def test_quality_of_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    got = queries.op10_quality(spark, big).toPandas()
    both = got.merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    unseen = both[both["held_out"]]
    assert got["score"].between(0, 1).all() and len(got) == 1000
    good, bad = unseen[unseen["quality"] == 1], unseen[unseen["quality"] == 0]
    order = pd.concat([good, bad])["score"].rank().to_numpy()[: len(good)].sum()
    area = (order - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert area > 0.95 and (unseen["predicted"] == unseen["quality"]).mean() > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a b", "y")] * 2, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (1, None), (77, 0), (4, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score(docs, quality.train(docs, known)).collect()
        assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if not (r["doc_id"] or 0 > 2) and r["doc_id"] in (0, 1, 2)}) <= 1
    assert quality.score(docs.limit(0), quality.train(docs, labels)).collect() == []
