"""Names, words, rendering and the watchlist itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N, render as R
from ..functions.unicode import ascii_host, fold
from ..operators.search import match_names
from ..operators.watchlist import compile_watchlist, normalize_watchlist
from .catalogue import query
from .views import NAMES_SQL, names, table

PARTS_SQL = """labels AS (SELECT domain, plain, string_split(plain, '.') AS l, len(string_split(plain, '.')) AS n FROM plains),
widths AS (SELECT *, CASE WHEN n >= 2 AND length(l[n]) = 2 AND l[n-1] IN
  ('com','net','org','gov','edu','co','ac','mil','biz','info','nic','sch','ltd','plc','or','ne','go','gob','gouv') THEN 2
  WHEN n >= 2 THEN 1 ELSE 0 END AS w FROM labels),
parts AS (SELECT domain, plain, coalesce(l[n-w], '') AS part_name, array_to_string(l[n-w+1:n], '.') AS suffix,
  l[1:n-w-1] AS sub FROM widths)"""
PLAINS_SQL = "plains AS (SELECT domain, regexp_replace(lower(domain), '^[*][.]', '') AS plain FROM names)"


@query("host_from", """SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages""")
def host_from(spark, folder):
    rows = table(spark, folder, "pages").withColumn("_h", N.host_text(F.col("url")))
    return rows.select("page_id", F.coalesce(ascii_host(F.col("_h")), F.lit("")).alias("host"))


@query("split_domain", f"""WITH {NAMES_SQL}, {PLAINS_SQL}, {PARTS_SQL}
SELECT domain, part_name, suffix, array_to_string(sub, ' ') AS sub FROM parts""")
def split_domain(spark, folder):
    parts = names(spark, folder).withColumn("p", N.split_domain(N.bare_name(F.col("domain"))))
    return parts.select("domain", F.col("p.name").alias("part_name"), "p.suffix", F.array_join("p.sub", " ").alias("sub"))


@query("fold_text", """SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents""")
def fold_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


@query("unswap", f"""WITH {NAMES_SQL}
SELECT domain, translate(replace(replace(domain, 'rn', 'm'), 'vv', 'w'), '01345789', 'oleastbg') AS as_l,
       translate(replace(replace(domain, 'rn', 'm'), 'vv', 'w'), '01345789', 'oieastbg') AS as_i FROM names""")
def unswap(spark, folder):
    return names(spark, folder).select(
        "domain", N.unswap(F.col("domain"), 0).alias("as_l"), N.unswap(F.col("domain"), 1).alias("as_i"))


@query("find_word", r"""WITH t AS (SELECT doc_id, lower(text) AS x FROM documents)
SELECT doc_id, CAST(instr(x, 'there') - 1 AS INTEGER) AS anywhere,
  CAST(CASE WHEN regexp_matches(x, '(?s)(^|[^\p{L}\p{N}])the')
       THEN length(regexp_extract(x, '(?s)^(.*?(^|[^\p{L}\p{N}]))the', 1)) ELSE -1 END AS INTEGER) AS at_start FROM t""")
def find_word(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("x"))
    return rows.select("doc_id", N.find_word(F.col("x"), "there").alias("anywhere"), N.find_word(F.col("x"), "the").alias("at_start"))


LURES = ("login signin secure verify verification update account auth otp pay payment billing invoice refund wallet bank card "
         "reward gift prize claim confirm unlock support service kyc fines parcel delivery tracking customs").split()
LURES_SQL = "lure(w) AS (VALUES " + ",".join(f"('{w}')" for w in LURES) + ")"
FOUND_SQL = r"""(CASE WHEN length(w) >= 5 THEN contains(plain, w) ELSE regexp_matches(plain, '(^|[^\p{L}\p{N}])' || w) END)"""


@query("lure_words", f"""WITH {NAMES_SQL}, {PLAINS_SQL}, {LURES_SQL}
SELECT domain, string_agg(w, ' ' ORDER BY w) AS words FROM plains JOIN lure ON {FOUND_SQL} GROUP BY domain""")
def lure_words(spark, folder):
    rows = names(spark, folder).withColumn("l", N.lure_words(N.bare_name(F.col("domain"))))
    return rows.filter(F.size("l") > 0).select(
        "domain", F.array_join(F.array_sort(F.transform("l", lambda w: w["word"])), " ").alias("words"))


@query("osa_distance", f"""WITH {NAMES_SQL}, {PLAINS_SQL}, {PARTS_SQL}
SELECT domain, CAST(least(damerau_levenshtein(coalesce(sub[1], part_name), 'tiontion'), 2) AS INTEGER) AS distance FROM parts""")
def osa_distance(spark, folder):
    rows = names(spark, folder).withColumn("p", N.split_domain(N.bare_name(F.col("domain"))))
    lead = F.coalesce(F.get("p.sub", F.lit(0)), F.col("p.name"))
    return rows.withColumn("lead", lead).select("domain", N.osa_distance(F.col("lead"), F.lit("tiontion"), 1).alias("distance"))


@query("severity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 80 THEN 'high' WHEN l_quantity * 2 >= 60 THEN 'medium' "
                   "ELSE 'low' END AS severity, l_quantity * 2 >= 60 AS at_least_medium FROM lineitem")
def severity(spark, folder):
    level = N.severity_of(F.col("l_quantity") * 2)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", level.alias("severity"), N.at_least(level, "medium").alias("at_least_medium"))


@query("short_log_name", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '2024h1' ELSE 'Maker ' || event_type END AS log
FROM events""")
def short_log_name(spark, folder):
    events = table(spark, folder, "events")
    full = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Let's Encrypt '"), "event_type", F.lit("2024h1' log"))).otherwise(
        F.concat(F.lit("Maker "), "event_type", F.lit(" Log")))
    return events.withColumn("full", full).select("event_id", N.short_log_name(F.col("full")).alias("log"))


@query("issuer_name", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' CA R1'
  WHEN c_custkey % 3 = 1 THEN c_mktsegment || ', Inc. Root X1' ELSE c_name END AS issuer FROM customer""")
def issuer_name(spark, folder):
    rows = table(spark, folder, "customer")
    third = F.col("c_custkey") % 3
    org = F.when(third == 0, F.col("c_mktsegment")).when(third == 1, F.concat("c_mktsegment", F.lit(", Inc.")))
    cn = F.when(third == 0, F.concat("c_mktsegment", F.lit(" CA R1"))).when(third == 1, F.lit("Root X1")).otherwise(F.col("c_name"))
    return rows.withColumn("o", org).withColumn("cn", cn).select("c_custkey", N.issuer_name(F.col("o"), F.col("cn")).alias("issuer"))


@query("match_names", f"""WITH {NAMES_SQL}
SELECT domain, CASE WHEN contains(domain, 'casino') OR contains(domain, 'login') OR regexp_matches(domain, '(?i)PAY[.]test$')
  THEN domain WHEN contains(domain, 'tion') THEN 'x.' || domain || '.login.test' END AS hit FROM names""")
def match(spark, folder):
    rows = names(spark, folder)
    decoy = F.when(F.contains("domain", F.lit("tion")), F.concat(F.lit("x."), "domain", F.lit(".login.test"))).otherwise("none.test")
    listed = rows.withColumn("all_domains", F.array("domain", decoy))
    return match_names(listed, [r"PAY[.]test$"], ["casino, login"]).select("domain", "hit")


@query("tile_path", """SELECT DISTINCT o_orderkey, CASE
  WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0')
  WHEN o_orderkey < 1000000 THEN 'x' || lpad(CAST(o_orderkey // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')
  ELSE 'x' || lpad(CAST(o_orderkey // 1000000 AS VARCHAR), 3, '0') || '/x' || lpad(CAST(o_orderkey // 1000 % 1000 AS VARCHAR), 3, '0')
    || '/' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS path FROM orders""")
def tile_path(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey").distinct().select(
        "o_orderkey", R.tile_path(F.col("o_orderkey")).alias("path"))


@query("csv_field", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text ELSE text END AS x FROM documents),
 d AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^[=+\-@\t\r]') THEN '''' || x ELSE x END AS x FROM t)
SELECT doc_id, md5(CASE WHEN contains(x, '"') OR contains(x, ',') OR contains(x, chr(10)) THEN '"' || replace(x, '"', '""') || '"' ELSE x END) AS cell FROM d""")
def csv_field(spark, folder):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", text.alias("x")).select("doc_id", F.md5(R.csv_field(F.col("x"))).alias("cell"))


_KEY = b"k3y".ljust(64, b"\0")
_IN, _OUT = (bytes(b ^ p for b in _KEY).hex() for p in (0x36, 0x5C))


@query("sign_body", f"""SELECT doc_id, 'sha256=' || sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(text)))) AS signature
FROM documents""")
def sign_body(spark, folder):
    return table(spark, folder, "documents").select("doc_id", R.sign_body(F.col("text"), "k3y").alias("signature"))


def _entries(spark, folder):
    """A supplier table read as a watchlist, some rows of it unusable."""
    part = table(spark, folder, "part")
    third = F.col("p_partkey") % 5
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    return part.select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.when(third == 4, "pattern").otherwise("brand").alias("kind"),
        F.col("p_name").alias("name"), F.lit(None).cast("boolean").alias("enabled"),
        F.when(third < 2, F.array(F.concat(F.lit("*."), F.upper(brand), F.when(third == 0, ".test.").otherwise("")))).alias("domains"),
        F.when(third == 2, F.split("p_name", " ")).when(third == 0, F.array(F.lower("p_type"), F.lower("p_type"))).alias("keywords"),
        F.when(third == 4, F.concat("p_name", F.lit("$"))).alias("pattern"),
        F.when(third == 4, F.when(F.col("p_size") > 25, "high").otherwise("urgent")).alias("severity"))


_ENTRIES_SQL = """e AS (SELECT p_partkey, p_partkey % 5 AS k, lower(replace(p_brand, '#', '-')) AS b, p_name, lower(p_type) AS t, p_size FROM part)"""


@query("normalize_watchlist", f"""WITH {_ENTRIES_SQL}
SELECT 'e' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN k = 0 THEN b || '.test' ELSE '' END AS domains,
  CASE WHEN k = 0 THEN t WHEN k = 2 THEN replace(p_name, ' ', ',') ELSE '' END AS keywords,
  CASE WHEN k = 1 THEN 'cannot be a domain: *.' || upper(b) WHEN k = 3 THEN 'a brand without domains and keywords'
       WHEN k = 4 AND p_size <= 25 THEN 'unknown severity'
       ELSE '' END AS errors FROM e""")
def normalize(spark, folder):
    valid, rejected = normalize_watchlist(_entries(spark, folder))
    rows = valid.withColumn("errors", F.array().cast("array<string>")).unionByName(rejected, allowMissingColumns=True)
    good = F.size("errors") == 0

    def joined(c):
        return F.when(good, F.coalesce(F.array_join(c, ","), F.lit(""))).otherwise("")

    return rows.select("id", joined("domains").alias("domains"), joined("keywords").alias("keywords"), F.array_join("errors", ";").alias("errors"))


@query("compile_watchlist", f"""WITH {_ENTRIES_SQL}
SELECT 'e' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN k = 0 THEN t || ',' || b ELSE replace(p_name, ' ', ',') END AS words,
  CASE WHEN k = 0 THEN b || ':test' ELSE '' END AS endings FROM e WHERE k = 0 OR k = 2""")
def compiled(spark, folder):
    valid, _ = normalize_watchlist(_entries(spark, folder))
    return compile_watchlist(valid).brands.select(
        F.col("watch_id").alias("id"), F.array_join("words", ",").alias("words"),
        F.array_join(F.transform("endings", lambda e: F.concat(e["name"], F.lit(":"), F.array_join(e["real"], ","))), ";").alias("endings"))
