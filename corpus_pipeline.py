"""A training corpus in five stages: classify, filter, de-duplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of ``documents``, and other columns of its input are not read. An empty table gives an empty one.
Repeated rows are documents of their own but for the third stage. ``run`` writes every stage's rows as Parquet
in the shared scratch folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import jaccard_join, mixing, packing, quality_model, quality_rules
from marlstone.llm.shared import Scratch
from marlstone.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the classifier's cut go. A null text is scored as an empty one."""
    docs = docs.select(*COLUMNS)
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, keep=docs.columns).where(F.col("score") >= quality_model.CUT).drop("score")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them."""
    docs = docs.select(*COLUMNS)
    return quality_rules.apply_rules(docs).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Rows that repeat an id are copies of one document, of which one stays. Documents without words stay, and
    rows without id stay unless each of them has a copy with an id.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark, "dedup")
    found = jaccard_join.join(docs, scratch, width=5, num=8, den=10)
    first = scratch.save(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n")), "first")
    once, again, nameless = (first.where(c) for c in ("n = 1 and doc_id is not null", "n > 1 and doc_id is not null", "doc_id is null"))
    kept = docs.join(once.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*COLUMNS)
    if not again.isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
        rows = docs.join(again.select("doc_id"), "doc_id", "left_semi").withColumn("_nth", nth)
        kept = kept.unionByName(rows.where("_nth = 1").select(*COLUMNS))
    return kept if nameless.isEmpty() else kept.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the curriculum takes it, in training order. Rows without words come once at most."""
    return mixing.mixed_documents(docs.select(*COLUMNS), Scratch(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence. A null text is packed as an empty one."""
    return packing.pack(docs.select(*COLUMNS), Scratch(spark, "pack"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_jaccard_join", deduplicate), ("source_mix", mix), ("best_fit_packing", pack)]

#: The first stage is learnt and the last is a tokenizer's and a packer's work; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
