"""Watchlists, alert logs, issuer certificates and positions from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.alerts import DNS
from ..operators.detect import EVIDENCE
from ..operators.watchlist import SCHEMA

_ITEM = ("id string, kind string, name string, enabled boolean, created_at string, updated_at string, "
         "domains string, keywords string, pattern string, severity string")
ALERT = (
    "struct<id:string,created_at:timestamp,last_seen:timestamp,updated_at:timestamp,count:bigint,status:string,note:string,"
    f"severity:string,score:int,reasons:array<string>,evidence:array<{EVIDENCE}>,domain:string,unicode:string,"
    "watch:struct<id:string,name:string,kind:string>,cert:struct<sha256:string,update_type:string,issuer:string,"
    "not_before:bigint,not_after:bigint,all_domains:array<string>,log:string,log_url:string,cert_index:bigint,"
    f"cert_link:string>,dns:{DNS}>"
)
EVENTS = f"seq bigint, type string, alert {ALERT}, id string, at timestamp, status string, note string, dns {DNS}"


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a watchlist file, ``{"items": [...]}`` or a bare list.

    Domains and keywords may be lists or texts; both become lists.
    """
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in _ITEM.split(","))
    raw = spark.read.schema(f"items array<struct<{fields}>>, {_ITEM}").option("multiLine", True).json(path)
    bare = F.struct(*[c.split()[0] for c in _ITEM.split(", ")])
    items = raw.select(F.explode(F.coalesce("items", F.array(bare))).alias("i")).select("i.*")

    def listed(column: str):
        text = F.col(column)
        return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")).when(
            text.isNotNull(), F.filter(F.split(text, r"[\s,]+"), lambda v: v != ""))

    return items.withColumn("domains", listed("domains")).withColumn("keywords", listed("keywords")).select(
        *[f.name for f in SCHEMA.fields])


def read_alert_events(spark: SparkSession, path: str) -> DataFrame:
    """An alert event log of JSON lines; blank and torn lines are skipped.

    Lines without a ``seq`` are numbered by file name and place in the file,
    above every number that is given.
    """
    lines = spark.read.schema(EVENTS + ", _corrupt_record string").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # Within a split row numbers rise; splits are few, and are put in order by name and start.
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.select("*", split.alias("_split"), F.monotonically_increasing_id().alias("_row"))
    splits = placed.groupBy("_split").agg(F.max("seq").alias("_top"))
    order = splits.select("_split", F.row_number().over(W.orderBy("_split")).cast("bigint").alias("_no"),
                          F.coalesce(F.max("_top").over(W.partitionBy()), F.lit(0)).alias("_base"))
    # The row's place in its split: the low bits of the row id.
    behind = F.col("_base") + F.shiftleft(F.col("_no"), 33) + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    whole = placed.join(order, "_split").withColumn("seq", F.coalesce("seq", behind)).drop("_split", "_row", "_no", "_base")
    kept = whole.filter("_corrupt_record is null and type is not null").drop("_corrupt_record")
    return kept.withColumn("id", F.coalesce("id", "alert.id")).withColumn("at", F.coalesce("at", "alert.created_at"))


def read_issuers(spark: SparkSession, path: str) -> DataFrame:
    """Landed issuer certificates named by fingerprint; only true ones are kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fp = F.lower(F.regexp_extract("path", r"([0-9A-Fa-f]{64})[^/]*$", 1))
    return verified_issuers(files.select(fp.alias("fp"), F.col("content").alias("der")))


def verified_issuers(issuers: DataFrame) -> DataFrame:
    """Issuer rows whose certificate has the fingerprint it is filed under."""
    return issuers.filter(F.sha2("der", 256) == F.col("fp")).dropDuplicates(["fp"])


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Saved reading positions, ``{"positions": {url: next}}``."""
    saved = spark.read.schema("positions map<string,bigint>").option("multiLine", True).json(path)
    return saved.select(F.explode("positions").alias("log_url", "next_index"))
