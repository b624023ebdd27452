"""A Bloom filter of documents, of fixed size, asked before texts are shuffled.

It never rules out a document that matters. If it is too full to rule out the others, more
texts are shuffled and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.encoding import column_of

FILTER_BITS = 26
"""2**26 bits, 8 MB, however many documents there are; one hash."""


def document_filter(ids: DataFrame) -> np.ndarray:
    """Filter of the values of column doc_id."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)) + 1  # the bitmap functions count from 1
    parts = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, bits in parts.collect():
        own = np.frombuffer(bits, np.uint8)
        at = (part - 1) * 4096
        out[at : at + len(own)] |= own
    return out


def with_bit(docs: DataFrame) -> DataFrame:
    """Documents with column _bit, their place in a filter."""
    return docs.withColumn("_bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("long"))


def passes(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Rows of a batch, with doc_id and _bit, that the filter does not rule out; null ids are ruled out."""
    bit = column_of(batch, "_bit").to_numpy(zero_copy_only=False)
    inside = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return inside & ~column_of(batch, "doc_id").is_null().to_numpy(zero_copy_only=False)


def may_matter(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Documents that the filter does not rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    hashed = with_bit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch, shared.value)))

    return hashed.mapInArrow(run, hashed.schema).drop("_bit")
