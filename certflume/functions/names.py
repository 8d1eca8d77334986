"""Host names, words and display names as native Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from . import let
from .unicode import ascii_host, fold_text

SPLIT = "struct<name:string,suffix:string,sub:array<string>>"
NOT_WORD = r"(?<![\p{L}\p{N}])"
_NONE = -1


def host_text(text: Column) -> Column:
    """Lower-case host part of a bare name or a pasted link, not yet checked."""
    given = F.regexp_replace(text, r"^\s+|\s+$", "")
    link = F.contains(given, F.lit("://"))
    authority = F.regexp_extract(given, r"^[A-Za-z][A-Za-z0-9+.\-]*:/{2,}([^/?#\\]*)", 1)
    from_link = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    host = F.when(link, from_link).otherwise(F.regexp_replace(given, r"[/?#].*$", ""))
    host = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.regexp_replace(host, r"^\*\.", "")


def host_from(text: Column) -> Column:
    """ASCII host of a bare name or a pasted link, empty when there is none."""
    return F.coalesce(ascii_host(host_text(text)), F.lit(""))


def bare_name(domain: Column) -> Column:
    """Lower case without a leading wildcard."""
    return F.regexp_replace(F.lower(domain), r"^\*\.", "")


def split_domain(domain: Column) -> Column:
    """Registrable name, ending and subdomain labels of a name."""
    return let(F.split(domain, r"\."), _split_labels)


def _split_labels(labels: Column) -> Column:
    n = F.size(labels)
    under_country = (n >= 2) & (F.length(F.element_at(labels, -1)) == 2) & (
        F.try_element_at(labels, F.lit(-2)).isin(*fv.SECOND_LEVEL)
    )
    width = F.when(under_country, 2).when(n >= 2, 1).otherwise(0)  # labels in the ending
    name = F.coalesce(F.try_element_at(labels, -(width + 1)), F.lit(""))
    suffix = F.array_join(F.slice(labels, n - width + 1, width), ".")
    sub = F.slice(labels, F.lit(1), F.greatest(n - width - 1, F.lit(0)))
    return F.struct(name.alias("name"), suffix.alias("suffix"), sub.alias("sub"))


def pieces(parts: Column) -> Column:
    """Subdomain labels and the name, each followed by its hyphen parts."""
    labels = F.concat(parts["sub"], F.array(parts["name"]))
    spread = F.flatten(F.transform(labels, lambda s: F.concat(F.array(s), F.split(s, "-"))))
    return F.filter(spread, lambda p: F.length(p) >= 3)


def word_regex(word: Column) -> Column:
    """Pattern that finds a short word where a word starts."""
    quoted = F.regexp_replace(word, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit(NOT_WORD), quoted)


def find_word(text: Column, word: Column | str, regex: Column | None = None) -> Column:
    """Where a word starts in a text, in code points from 0, or -1.

    Words of five letters or more match anywhere; shorter ones must start a
    word, so they do not match the middle of random strings.
    """
    if isinstance(word, str):
        if len(word) >= 5:
            return F.instr(text, F.lit(word)) - 1
        return _first_match(text, F.lit(NOT_WORD + re.escape(word)))
    pattern = word_regex(word) if regex is None else regex
    anywhere = F.instr(text, word) - 1
    return F.when(F.length(word) >= 5, anywhere).otherwise(_first_match(text, pattern))


def _first_match(text: Column, pattern: Column) -> Column:
    return let(F.split(text, pattern, 2),
               lambda around: F.when(F.size(around) > 1, F.length(around[0])).otherwise(F.lit(_NONE)))


def lure_words(text: Column) -> Column:
    """Lure words of a folded text with where they start and how long they are."""
    words = [(w, fold_text(w)) for w in fv.LURE_WORDS]

    def listed(long: bool) -> Column:
        # One array literal per kind; a few hundred expression nodes would
        # cost more to plan than to run.
        rows = ", ".join(f"named_struct('word', '{w}', 'folded', '{f}', 'no', {i})"
                         for i, (w, f) in enumerate(words) if (len(f) >= 5) == long)
        return F.expr(f"array({rows})")

    def found(w: Column, at: Column) -> Column:
        return F.struct(w["no"].alias("no"), w["word"].alias("word"), at.alias("at"), F.length(w["folded"]).alias("len"))

    anywhere = F.transform(listed(True), lambda w: found(w, F.instr(text, w["folded"]) - 1))
    at_start = F.transform(listed(False), lambda w: found(w, F.when(
        F.contains(text, w["folded"]), _first_match(text, F.concat(F.lit(NOT_WORD), w["folded"]))).otherwise(F.lit(_NONE))))
    hits = F.filter(F.concat(anywhere, at_start), lambda h: h["at"] >= 0)
    return F.transform(F.array_sort(hits), lambda h: h.dropFields("no"))


def unswap(text: Column, variant: int = 0) -> Column:
    """Undo digit and pair swaps; variant 0 reads a one as l, variant 1 as i."""
    for pair, one in fv.SWAP_PAIRS:
        text = F.replace(text, F.lit(pair), F.lit(one))
    return F.translate(text, "".join(fv.SWAPS), "".join(letters[variant] for letters in fv.SWAPS.values()))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def osa_distance(a: Column, b: Column, limit: int | Column = 2) -> Column:
    """Optimal string alignment distance, or ``limit + 1`` when it is larger.

    A swap of two neighbours is one edit. A row-by-row fold over arrays; run
    it only on candidate pairs.
    """
    top = (F.lit(limit) if isinstance(limit, int) else limit) + 1
    far = F.abs(F.length(a) - F.length(b)) >= top
    both = F.struct(letters(a).alias("x"), letters(b).alias("y"))
    return F.when(far, top).otherwise(F.least(let(both, lambda p: _osa(p["x"], p["y"])), top))


def _osa(x: Column, y: Column) -> Column:
    n, m = F.size(x), F.size(y)

    def next_row(state: Column, i: Column) -> Column:
        above, before = state["prev"], state["before"]

        def cell(row: Column, j: Column) -> Column:
            same = F.when(x[i - 1] == y[j - 1], 0).otherwise(1)
            swapped = (i > 1) & (j > 1) & (x[i - 1] == F.get(y, j - 2)) & (F.get(x, i - 2) == y[j - 1])
            best = F.least(above[j] + 1, row[j - 1] + 1, above[j - 1] + same,
                           F.when(swapped, F.get(before, j - 2) + 1))
            return F.concat(row, F.array(best))

        row = F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell)
        return F.struct(above.alias("before"), row.alias("prev"))

    start = F.struct(F.sequence(F.lit(0), m).alias("before"), F.sequence(F.lit(0), m).alias("prev"))
    full = F.aggregate(F.sequence(F.lit(1), n), start, next_row, lambda s: F.element_at(s["prev"], -1))
    return F.when(n == 0, m).when(m == 0, n).otherwise(full)


def severity_of(score: Column) -> Column:
    return F.when(score >= fv.SCORE_HIGH, "high").when(score >= fv.SCORE_MEDIUM, "medium").otherwise("low")


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for pair in fv.SEVERITY_RANK.items() for v in pair])
    return F.element_at(ranks, severity)


def at_least(severity: Column, minimum: str) -> Column:
    return severity_rank(severity) >= fv.SEVERITY_RANK[minimum]


def short_log_name(name: Column) -> Column:
    quoted = F.regexp_extract(name, r" '([^']+)'", 1)
    plain = F.regexp_replace(name, r"(?i)\s+log$", "")
    return F.trim(F.when(quoted != "", quoted).otherwise(plain))


def issuer_name(org: Column, cn: Column) -> Column:
    """The common name alone when it repeats the organisation's first word."""
    org, cn = F.nullif(org, F.lit("")), F.nullif(cn, F.lit(""))
    first = F.lower(F.split(org, r"[\s,.]+")[0])
    repeats = (first != "") & F.contains(F.lower(cn), first)
    return F.when(repeats, cn).otherwise(F.concat_ws(" ", org, cn))
