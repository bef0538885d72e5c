"""Pipeline over `documents`: quality rules, near-duplicate removal, secret scans, mixing, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the next
docs, with the columns of documents in all stages but the last. Between stages the rows are written
to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import mixing, ngram_join, packing, quality, secrets
from cueloom.llm.common import stored

#: Texts are kept whole where a mix repeats or drops documents.
MIX = mixing.Mix(split_documents=False)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fitted verdict reject go.

    Null, empty and wordless texts are rejected. All columns stay as they are, also those named like a
    measure; null and repeated ids pass by their own texts; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    return quality.rate(whole, model).filter("kept").select("doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays, the one of the smallest doc_id.

    Rows are told apart by doc_id and text (a 64-bit hash of both), so a row that shares its doc_id with
    a copy stays if its own text is no copy. Of rows equal in doc_id and text one stays. A null doc_id
    comes after all others. Texts without words are copies of nothing: all of them stay. Other columns
    don't matter; an empty table stays empty.
    """
    row = F.xxhash64(F.col("doc_id"), F.col("text"))
    found = ngram_join.near_duplicates(docs.select(row.alias("doc_id"), "text"))
    groups = stored(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("row")).agg(F.max("component_id").alias("component"), F.count(F.lit(1)).alias("n")))
    ids = docs.groupBy(row.alias("row")).agg(F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    kept = groups.join(ids, "row").groupBy("component").agg(first).select("row")
    gone = stored(groups.select("row").join(kept, "row", "left_anti"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("row"))
    whole = whole.join(gone, "row", "left_anti")
    several = groups.filter("n > 1").select("row")
    once = whole.join(several, "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
    return whole.join(several, "row", "left_anti").select("doc.*").unionByName(once.select("doc.*"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, with null ids, repeated rows and null or empty texts as they are."""
    return secrets.redact(docs).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; odd rows as `mixing.mixed_rows` says."""
    return mixing.mixed_rows(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; odd rows as `packing.pack_texts` says."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", secret_scans),
    ("mixing to target weights", mix_to_weights),
    ("packing", pack),
]

#: The stages aren't expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
