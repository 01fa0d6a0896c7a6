"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import small_batches


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def featurized(make, column: str = "text"):
    """An Arrow function from (y, text) to (y, feature ids as bytes)."""

    def run(batches):
        features = make()
        for batch in batches:
            ids = [features(x or "").astype(np.int32).tobytes() for x in batch.column(column).to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(ids, pa.binary())], ["y", "ids"])

    return run


def sample(docs: DataFrame, labels: DataFrame, label: str, make, bound: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and feature ids of at most `bound` labelled documents, those with the least id hashes.

    An id labelled twice takes its larger label and an id with several texts its
    least text; ids without a document, and null ids or labels, are left out.
    """
    small_batches(docs.sparkSession)
    picked = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    picked = picked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    # labels of documents that aren't there don't count towards the bound
    picked = picked.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi")
    # a threshold first, so that tasks don't each send `bound` rows; it leaves enough but for one chance in ten thousand
    share = min(1.0, (bound + 4 * bound**0.5 + 16) / max(1, picked.count()))
    picked = picked.filter(F.xxhash64("_id") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")
    texts = texts.groupBy("_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    got = texts.mapInArrow(featurized(make), "y int, ids binary").toArrow().sort_by([("y", "ascending"), ("ids", "ascending")])
    return got.column("y").to_numpy().astype(np.int8), [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("ids")]


def scored(df: DataFrame, make, score, text_col: str, out: str) -> DataFrame:
    """df with the column `out`: score(feature ids) of every whole text; a null text counts as empty. A column of that name is replaced."""
    df = df.drop(out)
    held = df.columns

    def run(batches):
        features, rate = make(), score()
        for batch in batches:
            values = [rate(features(x or "")) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*held, out])

    from pyspark.sql.types import DoubleType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, DoubleType()))
