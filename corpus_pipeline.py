"""Documents in, packed training sequences out.

STAGES run in order, each on all rows that the one before kept, and each decision
takes effect: toxic documents go, bad ones go, one document of each group of near
duplicates stays, documents that hold a benchmark passage go, the rest is packed.
The classifiers learn from the labelled rows of `labels` among the documents that
reach their stage. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabmend.llm.common import WRITTEN, discard, materialize, read, unused
from tabmend.llm.decontam import decontaminated
from tabmend.llm.neardup import near_duplicates
from tabmend.llm.packing import pack
from tabmend.llm.quality import quality_scores
from tabmend.llm.queries import encoder
from tabmend.llm.toxicity import toxicity_scores

#: What every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Probabilities at which a document counts as toxic, and as good.
TOXIC, GOOD = 0.3, 0.5
#: Per cent of shared shingles at which documents count as near duplicates; op6's 85 is that query's own.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = unused(docs, "score")
    scored = toxicity_scores(docs, docs, read(spark, sf_dir, "labels"), out=score)
    return scored.filter(F.col(score) < TOXIC).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = unused(docs, "score")
    scored = quality_scores(docs, docs, read(spark, sf_dir, "labels"), out=score)
    return scored.filter(F.col(score) >= GOOD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the least id; of rows equal in id and text, one."""
    found = near_duplicates(docs, percent=NEAR).filter("kept")
    least = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash")
    alone = found.filter("group is null").select("doc_id", "text_hash")
    the_id, the_hash, own, n = (unused(docs, x) for x in ("stay_id", "stay_hash", "own_hash", "copy"))
    stays = least.unionByName(alone).distinct().select(F.col("doc_id").alias(the_id), F.col("text_hash").alias(the_hash))
    left = docs.withColumn(own, F.xxhash64("text")).join(stays, F.col("doc_id").eqNullSafe(F.col(the_id)) & (F.col(own) == F.col(the_hash)), "left_semi")
    return left.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", own).orderBy("text"))).filter(F.col(n) == 1).drop(n, own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, encoder())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifiers, MinHash and packing are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for at, (_, stage) in enumerate(STAGES):
        mark = len(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
            discard(spark, before + WRITTEN[mark:-1])
            before = WRITTEN[-1:]
    return docs
