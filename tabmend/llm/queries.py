"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabmend.llm.common import read
from pyspark.sql import functions as F

from tabmend.llm.decontam import contaminated
from tabmend.llm.labelled import remainder
from tabmend.llm import licences
from tabmend.llm.langid import languages
from tabmend.llm.neardup import near_duplicates
from tabmend.llm.ngram_lm import lm_scores
from tabmend.llm.omh import order_minhash
from tabmend.llm.packing import byte_pair_encoder, pack
from tabmend.llm.quality import quality_scores
from tabmend.llm.shards import shard_by_sampled_splitters
from tabmend.llm.toxicity import decided, toxicity_scores


def _classified(spark: SparkSession, sf_dir: str, scores, threshold: float) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    labels = read(spark, sf_dir, "labels").filter(~held)
    out = scores(docs.select("doc_id", "text"), docs, labels)
    return decided(out, threshold).select("doc_id", held.alias("held_out"), "score", "predicted")


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity_scores, 0.3)


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_sampled_splitters(read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op3_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_scores, 0.7)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85).drop("text_hash", "group")


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(read(spark, sf_dir, "documents"))


def encoder(path: str | None = None):
    """A maker of encoders by the vocabulary file at `path`, which by default the executor's own public_tokenizers names."""

    def make():
        import public_tokenizers

        return byte_pair_encoder(path or public_tokenizers.path("byte_bpe_50k.json"))

    return make


def op9_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), encoder())


def op10_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_language_evidence": op3_language_evidence,
    "op4_simhash_decontamination": op4_simhash_decontamination,
    "op5_quality_nbsvm": op5_quality_nbsvm,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_backoff_lm": op7_backoff_lm,
    "op8_order_minhash": op8_order_minhash,
    "op9_cutting_stock_packing": op9_cutting_stock_packing,
    "op10_licence_sentences": op10_licence_sentences,
}

#: DuckDB SQL for the queries that it can express.
ORACLES: dict[str, str] = {
    "op10_licence_sentences": licences.oracle(),
    "op6_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, any_value(n.n) AS n_shingles, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM r JOIN n ON n.doc_id = r.x GROUP BY r.x""",
}
