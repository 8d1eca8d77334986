"""Certificate-shaped views of the given tables.

Every view reads a whole table. Each has a Spark form and, for the oracles,
the same rows as plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.watchlist import CompiledWatchlist, compile_watchlist, watchlist_frame
from ..session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name != "events":
        return df
    # Stored without a zone; every session here runs in UTC. The table is one file of one part, which no scan
    # can split: its rows are dealt out where they land, so that what follows runs on all cores.
    stamped = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else stamped


HOSTS_SQL = "hosts AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)"


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


# Names as they are, and as an imitator would bend them.
NAMES_SQL = HOSTS_SQL + """,
stems AS (SELECT host, regexp_replace(host, '[.][^.]*$', '') AS stem FROM hosts),
names AS (
  SELECT DISTINCT domain FROM (
    SELECT host AS domain FROM stems
    UNION ALL SELECT replace(host, '.', '-') || '.test' FROM stems
    UNION ALL SELECT stem || '-login.test' FROM stems
    UNION ALL SELECT translate(stem, 'oea', '034') || '.test' FROM stems
    UNION ALL SELECT substr(stem, 1, length(stem) - 2) || substr(stem, length(stem), 1)
                     || substr(stem, length(stem) - 1, 1) || '.pay.test' FROM stems
    UNION ALL SELECT host || '.verify-pay.test' FROM stems
    UNION ALL SELECT '*.' || replace(host, 'm', 'rn') FROM stems
  ) v)"""


def names(spark: SparkSession, folder: str) -> DataFrame:
    stem = F.regexp_replace("host", "[.][^.]*$", "")
    rows = hosts(spark, folder).select("host", stem.alias("stem"))
    n = F.length("stem")
    bent = F.array(
        F.col("host"), F.concat(F.replace("host", F.lit("."), F.lit("-")), F.lit(".test")),
        F.concat("stem", F.lit("-login.test")), F.concat(F.translate("stem", "oea", "034"), F.lit(".test")),
        F.concat(F.substring("stem", F.lit(1), n - 2), F.substring("stem", n, F.lit(1)),
                 F.substring("stem", n - 1, F.lit(1)), F.lit(".pay.test")),
        F.concat("host", F.lit(".verify-pay.test")), F.concat(F.lit("*."), F.replace("host", F.lit("m"), F.lit("rn"))))
    return rows.select(F.explode(bent).alias("domain")).distinct()


# Certificates: one per event, named by a page, issued by one of ten organisations.
CERTS_SQL = HOSTS_SQL + """,
certs AS (
  SELECT e.event_id AS idx, e.ts AS seen, e.event_id % 2 AS entry_type, e.event_type AS log, e.user_id,
         'https://' || e.event_type || '.log.example/' AS log_url, 'Org ' || CAST(e.user_id % 10 AS VARCHAR) AS org,
         'CA ' || CAST(e.user_id % 7 AS VARCHAR) AS cn, h.host
  FROM events e JOIN hosts h ON h.page_id = e.event_id % (SELECT count(*) FROM pages))"""


def certs(spark: SparkSession, folder: str) -> DataFrame:
    """Certificates in parsed form, without going through bytes."""
    pages = hosts(spark, folder)
    total = pages.agg(F.count(F.lit(1)).alias("pages"))
    named = table(spark, folder, "events").withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").withColumn(
        "page_id", F.col("event_id") % F.col("pages")).join(pages, "page_id")
    issuer = F.struct(F.concat(F.lit("Org "), (F.col("user_id") % 10).cast("string")).alias("O"),
                      F.concat(F.lit("CA "), (F.col("user_id") % 7).cast("string")).alias("CN"))
    return named.select(
        F.concat(F.lit("https://"), "event_type", F.lit(".log.example/")).alias("log_url"), F.col("event_type").alias("log_name"),
        F.col("event_id").alias("index"), (F.col("event_id") % 2).cast("int").alias("entry_type"), F.col("ts").alias("seen"),
        F.concat(F.lit("https://"), "event_type", F.lit(".log.example/"), F.col("event_id").cast("string")).alias("link"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"), "user_id",
        F.struct(issuer.alias("issuer"), F.array("host", F.concat(F.lit("www."), "host")).alias("all_domains")).alias("parsed"))


# Findings: one per event, for the name of a user.
FINDINGS_SQL = """findings AS (
  SELECT event_id, ts AS seen, 'w' || CAST(user_id % 3 AS VARCHAR) AS watch_id, 'u' || CAST(user_id AS VARCHAR) || '.test' AS domain,
         CAST(user_id * 7 % 60 + 41 AS INTEGER) AS score, 'Org ' || CAST(event_id % 10 AS VARCHAR) AS issuer
  FROM events)"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings shaped like those of detection, with their certificate."""
    from ..functions.names import severity_of

    score = (F.col("user_id") * 7 % 60 + 41).cast("int")
    watch = F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string"))
    return table(spark, folder, "events").select(
        F.struct(watch.alias("id"), F.concat(F.lit("Watch "), watch).alias("name"), F.lit("brand").alias("kind")).alias("watch"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".test")).alias("domain"),
        F.lit(None).cast("string").alias("unicode"), score.alias("score"), severity_of(score).alias("severity"),
        F.array(F.lit("keyword")).alias("reasons"), F.lit(None).cast("string").alias("evidence"), F.col("ts").alias("seen"), "event_id",
        F.struct(F.concat(F.lit("Org "), (F.col("event_id") % 10).cast("string")).alias("issuer"), F.col("event_type").alias("log"),
                 F.col("event_id").alias("cert_index")).alias("cert"))


WATCHLIST = [
    {"id": "example", "kind": "brand", "name": "Example", "domains": ["example.com"], "keywords": []},
    {"id": "tion", "kind": "brand", "name": "Tiontion", "domains": ["tiontion.example.org"], "keywords": ["tiontion", "thering"]},
    {"id": "win", "kind": "brand", "name": "Win", "domains": ["win.test"], "keywords": ["win", "casino", "pills"]},
    {"id": "bets", "kind": "brand", "name": "Bets", "domains": ["bets.test", "cheap-pills.test"], "keywords": ["ththan", "therst"]},
    {"id": "off", "kind": "brand", "name": "Off", "domains": ["example.org"], "keywords": ["blog"], "enabled": False},
    {"id": "country", "kind": "pattern", "name": "Endings", "pattern": r"\.example\.(net|org)$", "severity": "high"},
    {"id": "mobile", "kind": "pattern", "name": "Mobile", "pattern": r"^M\.", "severity": "low"},
]


def watchlist(spark: SparkSession) -> CompiledWatchlist:
    configure(spark)
    return compile_watchlist(watchlist_frame(spark, WATCHLIST))
