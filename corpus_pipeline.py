"""Corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result and hands the reread table to the next stage.  In every stage a null
text is empty, an empty table stays empty, equal rows are judged alike, and
further columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rationflow.llm import decontam, line_dedup, ngram_join, quality, sp_codec
from rationflow.llm.queries import model_path
from rationflow.llm.util import documents, fresh, written


def _n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules reject go, and lines above the limit of their host;
    n_chars follows the text."""
    return _n_chars(quality.clean(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text."""
    return _n_chars(line_dedup.dedup_lines(docs))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with
    the smallest id stays, and rows equal in id and text stay once.  Documents
    are told apart by id and text, so texts that share an id, or have none
    (these come last), are judged each for itself; of one id the smaller hash
    goes first.  Empty texts are alike nothing."""
    k, t, part, first = fresh(docs, "k", "t", "part", "first")
    rows = docs.withColumns({k: F.xxhash64("doc_id", "text"), t: F.hash("text", "doc_id")})
    groups = (ngram_join.ngram_join(rows.select(F.col(k).alias("doc_id"), "text"), n=5, num=80, den=100)
              .select(F.col("doc_id").alias(k), F.col("component_id").alias(part)).distinct())
    place = F.struct(F.col("doc_id").isNull(), "doc_id", k, t).alias(first)
    best = (rows.select(k, t, "doc_id").distinct().join(groups, k).groupBy(part).agg(F.min(place).alias(first))
            .select(F.col(f"{first}.{k}").alias(k), F.col(f"{first}.{t}").alias(t)))
    return rows.join(best, [k, t], "left_semi").dropDuplicates([k, t]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.drop_contaminated(docs, items)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document (little-endian unsigned 32-bit integers) in
    place of its text; further columns stay."""
    coded = sp_codec.encode_decode(docs, model_path())
    kept = [c for c in docs.columns if c not in ("text", "ids", "decoded", "n_tokens", "round_trip")]
    return coded.select(*kept, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: Local alignment and BPE merges are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
