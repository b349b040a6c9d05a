"""From raw documents to tokens: five stages, each one of the operators of ``vocatio.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents. Nulls: a null text is empty for the quality score, has no
duplicates, no benchmark passage and no personal data, and encodes to no tokens. Repeated rows count
once from the second stage on. Texts of any length are taken whole. Empty tables give empty results.
Columns beside those of documents stay, whatever their names, but for those that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.llm import bpe, decontaminate, neardup, pii, quality
from vocatio.llm.storage import helper, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = helper(docs)
    return quality.score_quality(docs, model, result=score).where(F.col(score) >= 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, 0.8 or more) one row: that of the
    smallest doc_id with one text.

    Rows are grouped by their own text. Where a doc_id is null or stands for several texts, each of
    its texts goes by a key made of both, behind all doc_ids, so no text is lost with another one of
    its id. Of rows of one id and text the least by its columns, in their order, stays. Texts without words are no duplicates of other doc_ids' texts.
    """
    id_, several, key = helper(docs), helper(docs, helper(docs)), helper(docs, helper(docs), helper(docs, helper(docs)))
    text = F.xxhash64(F.col("text").isNull(), "text")
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text).alias("a"), F.max(text).alias("b")).where("n > 1 or doc_id is null")
    often = written(often.select(F.col("doc_id").alias(id_), F.expr("doc_id is null or a <> b").alias(several)))
    if often.isEmpty():
        rest = neardup.near_duplicates(docs, k=5, num=80, den=100).where(~F.col("kept")).select("doc_id")
        return docs.join(rest, "doc_id", "left_anti").select(*docs.columns)
    # ids of less than 2 ** 62 come before all made keys
    made = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), 2) + (1 << 62)
    marked = docs.join(often, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    keyed = marked.withColumn(key, F.when(F.col(several), made).otherwise(F.col("doc_id").cast("long"))).drop(id_)
    named = [f"`{c}`" for c in keyed.columns if c != key]
    least = keyed.where(F.col(several).isNotNull()).groupBy(key).agg(F.min(F.struct(*named)).alias(several)).select(f"{several}.*", key).select(*keyed.columns)
    once = keyed.where(F.col(several).isNull()).union(least)
    rest = neardup.near_duplicates(once, k=5, num=80, den=100, id_col=key).where(~F.col("kept")).select(key)
    return once.join(rest, key, "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in an occurrence of a window of ten benchmark words."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of personal data in place of each span; n_chars follows."""
    spans = helper(docs)
    found = pii.find_personal_data(docs, result=spans)
    masked = found.withColumn("text", pii.mask(F.col("text"), F.col(spans))).drop(spans)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their token ids, the number of these, and whether decoding gives the text back."""
    tokens = helper(docs)
    coded = bpe.tokenize(docs, bpe.default_path(), result=tokens)
    back = F.col(tokens)["decoded"] == F.coalesce("text", F.lit(""))
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    return coded.select(*kept, F.col(tokens)["ids"].alias("token_ids"), F.size(F.col(tokens)["ids"]).cast("long").alias("n_tokens"), back.alias("round_trip"))


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what lies between two of them is written once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs


#: Trained models decide in two of the stages, which SQL can't express; tests/llm holds the brute-force version.
ORACLE_SQL = None
