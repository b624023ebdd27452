"""A corpus pipeline of five operators, one stage after the other.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and, but for the
last, returns the columns of ``docs``. Extra columns pass through; names that an operator
adds cannot clash, as rows travel inside a struct. Defined results of the stages:

- language ID names the language of rows whose ``lang`` is null, and drops texts without a
  language (null, or without a letter) and no others, also where no language could be learned;
- the n-gram Jaccard join keeps of each class the document with the smallest id, of rows
  with one id the first by text; rows with a null id stay;
- substring dedup replaces texts; documents that lose every word go;
- benchmark decontamination drops documents that hold a benchmark item;
- best-fit packing returns the place of every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geotrail.llm import decontamination, jaccard_join, language_id, packing, substring_dedup
from geotrail.scratch import publish


def _wrapped(docs: DataFrame) -> DataFrame:
    """The text apart from the other columns, which it would otherwise be moved with twice."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")


def _unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language, and name the language of those that have no name for it."""
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(_wrapped(docs), model)
    named = F.coalesce(F.col("row.lang"), F.col("lang_pred").cast(dict(docs.dtypes)["lang"]))
    rows = found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("row", F.col("row").withField("lang", named))
    return _unwrapped(rows, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    classes = jaccard_join.join_similar(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    kept = _wrapped(docs).join(first, "doc_id", "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return _unwrapped(kept, docs).unionByName(docs.where("doc_id IS NULL"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has."""
    cut = substring_dedup.remove_repeats(_wrapped(docs)).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars"))}
    kinds = dict(docs.dtypes)
    return cut.select(*(new[c].cast(kinds[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_leaks(_wrapped(docs), items)
    return _unwrapped(found.where(F.size("leaks") == 0), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of 1024 tokens."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None
"""Tokenizers, context models and index searches are beyond SQL; tests use brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = publish(docs, f"stage{k}")
    return docs
