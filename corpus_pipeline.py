"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's documents. Documents that no stage has
a reason to drop or cut pass with all their columns as they are; rows with a null
text or id pass too, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from certflume.llm import decontaminate, near, pieces, substrings, toxicity
from certflume.llm.frames import noded, quoted, shared_folder
from certflume.llm.queries import PIECES

#: Words of a passage that is removed where it repeats.
PASSAGE_WORDS = 50


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text, so that no added column can meet one of its own."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("__doc"), F.col("text"))


def _unpacked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("__doc.*", *more)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), model, keep=["__doc"]).where("predicted = 0"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the smallest id, once.

    Rows with one id but unlike texts are documents of their own; of rows with equal id and text one stays.
    """
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("__doc"), F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))
    nodes = noded(packed, "__id", "__text", keep=["__doc"])
    rows = packed.withColumn("__node", F.col("__id")) if nodes is None else nodes
    kept = near.clusters(rows, "__node", "__text", shingle=5, percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    named = rows.join(kept, rows["__node"] == kept["__kept"], "left_semi").dropDuplicates(["__node"])
    return named.unionByName(rows.where("__node IS NULL")).select("__doc.*")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of PASSAGE_WORDS words or more that a document with a smaller id has."""
    cut = substrings.strip(docs, window=PASSAGE_WORDS, gram=PASSAGE_WORDS // 2, out="__removed")
    chars = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[chars.alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which benchmark windows cover a twentieth or more."""
    marked = decontaminate.judged(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__doc"])
    return _unpacked(marked.where("NOT contaminated"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add `token_ids` of each text and whether decoding them gives the text back."""
    model = pieces.Model.load(PIECES)
    coded = pieces.encode(_packed(docs), model, out="token_ids", keep=["__doc"], verify="round_trip")
    own = [F.col("__doc")[c].alias(c) for c in docs.columns if c not in ("token_ids", "round_trip")]
    return coded.select(*own, "token_ids", F.coalesce("round_trip", F.lit(True)).alias("round_trip"))


STAGES = [("toxicity", clean), ("near-dedup", distinct), ("substring dedup", unrepeated), ("decontamination", uncontaminated), ("sentencepiece", tokenized)]
#: No SQL expresses the trained and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = shared_folder(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
