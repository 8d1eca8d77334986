"""URL filter: host and path rules first, then a weighted vocabulary.

Rules are few and fixed, so they are a chain of column expressions, longest
first. The vocabulary is one Aho-Corasick automaton that reads each url once; a
hit counts only between characters that are no letters or digits. A term of
full weight (strict) rejects alone, several distinct soft terms together.

Nulls: a null url, or one without `://`, has empty host and path and no rule;
its text, if any, still meets the vocabulary. Repeated rows are judged alike.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import extend, quoted, struct, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A url is rejected when the weights of its distinct terms reach this.
REJECT_AT = 6
#: Strict terms weigh as much as that; of soft ones it takes two or three.
VOCABULARY = {
    "porn": 6, "xxx": 6, "hentai": 6, "camgirls": 6, "casino": 6, "phishing": 6, "malware": 6, "warez": 6, "spam-farm": 6,
    "adult": 3, "sex": 3, "nude": 3, "escort": 3, "betting": 3, "poker": 3, "viagra": 3, "torrent": 3, "crack": 3,
    "dating": 2, "loan": 2, "pills": 2, "cheap": 2, "free": 2, "win": 2, "bonus": 2, "click": 2, "spam": 2, "hack": 2,
}
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string) and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def weighed(df: DataFrame, url: str = "url", vocabulary: dict[str, int] = VOCABULARY, reject_at: int = REJECT_AT, keep=None) -> DataFrame:
    """Append strict_hits (all, repeats too), soft_hits (distinct terms) and weight (of distinct terms)."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        # Without any term there is nothing to walk.
        hits = automaton.iter if vocabulary and not automaton.make_automaton() else lambda text: ()
        table = str.maketrans(UPPER, LOWER)
        word = set(LOWER + "0123456789")
        out: list[tuple[int, int, int]] = []
        for text in batch.column("__text").to_pylist():
            text = (text or "").translate(table)
            strict, found = 0, {}
            for end, (term, weight) in hits(text):
                begin = end - len(term) + 1
                if (begin and text[begin - 1] in word) or (end + 1 < len(text) and text[end + 1] in word):
                    continue
                strict += weight >= reject_at
                found[term] = weight
            out.append((strict, sum(w < reject_at for w in found.values()), sum(found.values())))
        return [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]

    return extend(df, url, make, struct("strict_hits bigint, soft_hits bigint, weight bigint"), keep=keep)


def judge(df: DataFrame, url: str = "url", rules=RULES, vocabulary: dict[str, int] = VOCABULARY, reject_at: int = REJECT_AT, keep=None) -> DataFrame:
    """Append host, path, rule and verdict (allow or block), with the vocabulary's counts. Columns of these names are replaced."""
    keep = list(df.columns) if keep is None else keep
    kept = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")]
    own = weighed(df.select(*[quoted(c) for c in kept], F.col(quoted(url)).alias("__url")), "__url", vocabulary, reject_at)
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    out = without(own, ()).withColumn("host", host).withColumn("path", path)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("weight") >= reject_at, "block").otherwise("allow")))
    return out.drop("__url")


def oracle(vocabulary: dict[str, int] = VOCABULARY, reject_at: int = REJECT_AT, rules=RULES) -> str:
    """The same as DuckDB SQL over `pages`."""
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    weight = " + ".join(f"CASE WHEN regexp_matches({lower % 'url'}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in vocabulary.items())
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2]), reverse=True)
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for _, h, p in ordered]
    name = "CASE " + " ".join(f % (h + p) for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f % v for f, (v, _, _) in zip(fits, ordered, strict=True)) + f" WHEN weight >= {reject_at} THEN 'block' ELSE 'allow' END"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce({lower % "regexp_extract(rest, '^[^/?#]*', 0)"}, '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce({weight}, 0) AS weight FROM cut)
SELECT page_id, host, path, {name} AS rule, {verdict} AS verdict FROM parts"""
