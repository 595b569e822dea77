"""A corpus pipeline: quality classifier, exact dedup, near-dedup, secret scan, packing.

Each stage takes what its predecessor kept and, but for the last, returns rows with the
columns of ``documents``. A stage's decision is part of its result: rejected and duplicate
documents are gone, secrets are masked.

Decisions are made by row, not by id: a row is known by its id and 128 bits of its text.
Rows without an id and rows that share one take part as any; of a group one row stays,
also where several rows have the id that is kept. Null texts count as empty. Extra columns
are carried along unread. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import exact, minhash, packing, quality, secrets
from citeweave.llm.common import Scratch, materialize, results_dropped, row_key, small


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the classifier learns from all labelled documents.

    Null and empty texts get a score like any. Without labels of both classes all rows get
    the labels' mean (1 if there are none).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with Scratch(spark) as keep:
        # Statistics alone are written and meet the labels; texts are never shuffled.
        model = quality.learn(keep(quality.document_statistics(docs), "statistics"), labels, F.lit(True))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents (A-Z lower-cased) one row with the largest id stays; empty texts are one group."""
    return _one_of_each(docs, exact.exact_duplicates(docs, with_rows=True))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one row with the smallest id stays; rows without words all stay."""
    return _one_of_each(docs, minhash.near_duplicates(docs, with_rows=True))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` follows the text (null stays null)."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences of tokens: a row a piece, with its place in a sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _one_of_each(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, one of each group.

    ``decisions`` has a row (doc_id, row_key, kept, grouped) for every row of ``docs``. Only
    decisions against rows are joined, so few of them have to meet the texts.
    """
    key = ["doc_id", "row_key"]
    dropped = materialize(decisions.filter("not kept").select(*key).distinct().withColumn("one_of", F.lit(None).cast("string")), "dropped")
    # Groups in which several rows have the id that is kept, or none has an id.
    kept = decisions.filter("kept and grouped is not null").withColumn("one_of", F.col("grouped").cast("string"))
    several = kept.groupBy("one_of").agg(F.count("*").alias("n")).filter("n > 1").select("one_of")
    thinned = materialize(kept.select(*key, "one_of").join(several, "one_of", "left_semi").select(*key, "one_of").distinct(), "thinned")
    own = [F.col(f"`{c}`") for c in docs.columns]
    lead = "decided"  # begins the names of decisions, and of no column of ``docs``
    while any(c.lower().startswith(lead) for c in docs.columns):
        lead += "_"
    match = docs["doc_id"].eqNullSafe(F.col(f"{lead}0")) & (row_key(docs["text"]) == F.col(f"{lead}1"))
    against, among = (small(d.toDF(*(f"{lead}{k}" for k in range(3)))) for d in (dropped, thinned))
    stay = docs.join(against, match, "left_anti")
    if not thinned.limit(1).count():
        return stay.select(own)
    some = docs.join(among, match).select(F.struct(*own).alias("row"), f"{lead}2").dropDuplicates([f"{lead}2"])
    return stay.join(among, match, "left_anti").select(own).unionByName(some.select("row.*"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Classification, tokenising and packing can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has read, and what it wrote on its way, is dropped once it is written."""
    docs, keep = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        before = docs
        with results_dropped(spark):
            docs = keep(stage(spark, before, sf_dir), f"stage-{name}")
        keep.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
