"""The queries of this subpackage: each operator over its whole table, with its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, grams, language, near, pieces, quality, repair, substrings, topk, toxicity, urls, warc
from .frames import crc_mod, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op3_decontaminate", decontaminate.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op4_top_k", topk.ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


#: The public model that is read; a parameter of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, decoded again: their number, a digest, and whether the text came back (with ▁ read as a space)."""
    model = pieces.Model.load(PIECES)
    coded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model, keep=["doc_id"], verify="round_trip")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                        F.coalesce("round_trip", F.lit(True)).alias("round_trip"))


@query("op6_substring_dedup", substrings.ORACLE)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


@query("op7_near_dedup", near.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near.clusters(table(spark, folder, "documents"), shingle=4, percent=80)


@query("op8_url_filter", urls.oracle())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


@query("op9_warc", warc.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), archives)
    found = warc.payloads(warc.read(spark, archives), with_payload=False)
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.page_of(F.col("refers")).alias("refers_to"))


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    found = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


@query("op11_repair", repair.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(table(spark, folder, "conversations"))


@query("op12_gram_join", grams.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return grams.join(table(spark, folder, "documents"), shingle=5, percent=80)


#: The public byte-level vocabulary that is aligned with PIECES; a parameter of the operator.
BYTES = "/opt/tokenizers/byte_bpe_50k.json"


@query("op13_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.measure(table(spark, folder, "documents"), alignment.Vocabularies.load(BYTES, PIECES), keep=["doc_id"])
    return found.select("doc_id", *alignment.RESULTS)
