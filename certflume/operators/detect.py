"""Look-alike detection: names against a watchlist.

The plan for any number of names:

1. Every name is turned into hashed keys (grams of its folded and unswapped
   forms, its registrable name, parts of its pieces, grams of literals that
   patterns need) and meets the watchlist's keys in the Arrow step that makes
   them. The watchlist is limited to 500 entries, so its keys travel with the plan; names that
   share no key end here, without a shuffle. Patterns run on names that hold one of their literals; only those
   that need none run on all.
2. What survives, a row for each name and entry, is written once. Rows of one name are merged
   map-side, so a name that fills a third of the input still costs one row per
   task in the shuffle before scoring.
3. Each merged row is scored exactly. Keys only propose; they never decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import hold, let
from ..functions.keys import GRAM, SHORT, KeySpec, bitmap, edits, name_proposals, near_keys, part_keys, text_keys
from ..functions.literals import required
from ..functions.names import (
    bare_name, find_word, host_text, lure_words, pieces, severity_of, split_domain, unswap,
)
from ..functions.typos import typos
from ..functions.unicode import ascii_host, name_forms
from ..session import stored
from .watchlist import CompiledWatchlist, PinnedWatchlist, pin

EVIDENCE_FIELDS = {
    "reason": "string", "domain": "string", "form": "string", "written": "string",
    "at": "struct<from:int,to:int>", "name": "string", "ending": "string", "real": "array<string>",
    "word": "string", "chars": "array<struct<at:int,char:string,as:string,code:string,script:string>>",
    "label": "string", "swaps": "array<struct<at:int,from:string,to:string>>", "piece": "string",
    "distance": "int", "words": "array<string>", "spans": "array<struct<from:int,to:int>>",
    "ascii": "string", "pattern": "string", "on": "string",
}
EVIDENCE = "struct<" + ",".join(f"`{n}`:{t}" for n, t in EVIDENCE_FIELDS.items()) + ">"
FINDING = (
    "watch struct<id:string,name:string,kind:string>, domain string, unicode string, score int, "
    f"severity string, reasons array<string>, evidence array<{EVIDENCE}>"
)


# --- keys --------------------------------------------------------------------

def watch_keys(watch: PinnedWatchlist) -> KeySpec:
    """Every key that proposes an entry with the words it speaks for, and what
    a name has to be searched for. Bounded by the limits of a watchlist."""
    rows: list[tuple[np.ndarray, ...]] = []

    def add(no: np.ndarray, keys: np.ndarray, seen=0, near=0, word=-1, literal=-1) -> None:
        rows.append((keys, no, *(np.broadcast_to(np.asarray(x, np.int64), keys.shape) for x in (seen, near, word, literal))))

    words = watch.words
    no, bit = np.array([w[0] for w in words], np.int32), np.array([1 << w[1] for w in words], np.int64)
    lengths = np.array([len(w[2]) for w in words], np.int64)
    for tag, size, which in (("gram", GRAM, lengths >= GRAM), ("start", SHORT, lengths < GRAM)):
        add(no[which], text_keys([w[2][:size] for w, k in zip(words, which) if k], tag), bit[which])
    allowed = np.array([edits(n) for n in lengths], np.int64)
    which = np.flatnonzero(allowed == 1)
    row, keys = near_keys([words[i][2] for i in which])
    add(no[which[row]], keys, 0, bit[which[row]])
    long = np.flatnonzero(allowed == 2)
    row, keys = part_keys([words[i][2] for i in long])
    add(no[long[row]], keys, 0, bit[long[row]], row)
    own = [(n, f) for n, d in watch.domains if "." in d for f in (d, d.replace(".", "-"))]
    add(np.array([n for n, _ in own], np.int32), text_keys([f[:GRAM] for _, f in own], "gram"))
    add(np.array([n for n, _ in watch.names], np.int32), text_keys([r for _, r in watch.names], "name"))
    literals = [(n, text) for n, p in watch.patterns for text in required(p) or ()]
    add(np.array([n for n, _ in literals], np.int32), text_keys([t[:GRAM] for _, t in literals], "literal"), literal=np.arange(len(literals)))
    key, owner, seen, near, word, literal = (np.concatenate(c) for c in zip(*rows))
    order = np.argsort(key, kind="stable")
    short = lengths[allowed == 1]
    sizes = {min(len(f), GRAM) for _, f in own} | ({GRAM} if (lengths >= GRAM).any() else set())
    return KeySpec(
        tuple(sorted(sizes)), bool((lengths < GRAM).any()), (max(4, int(short.min()) - 1), int(short.max()) + 1) if len(short) else None,
        tuple(sorted({int(n) for n in lengths[long]})), tuple(sorted({min(len(t), GRAM) for _, t in literals})),
        key[order], owner[order].astype(np.int32), seen[order], near[order], word[order], literal[order],
        tuple(words[i][2] for i in long), tuple(t for _, t in literals), *bitmap(key))


def _everywhere(watch: PinnedWatchlist) -> list[Column]:
    """Proposals of the patterns that need no literal, so that every name has to be tried."""
    raw, shown = F.col("raw"), F.col("shown")
    zero = F.lit(0).cast("bigint")
    return [F.when(raw.rlike("(?iu)" + p) | F.coalesce(shown.rlike("(?iu)" + p), F.lit(False)),
                   F.struct(F.lit(no).alias("watch_no"), zero.alias("seen"), zero.alias("near")))
            for no, p in watch.patterns if required(p) is None]


# --- rows --------------------------------------------------------------------

def prepare(names: DataFrame) -> DataFrame:
    """Add the forms of ``domain`` that every rule reads."""
    named = names.withColumn("raw", bare_name(F.col("domain")))
    formed = named.withColumn("_forms", name_forms(F.col("raw"))).withColumns({
        "_seen": F.coalesce("_forms.unicode", "raw"), "plain": F.coalesce("_forms.text", "raw"),
        "origin": F.col("_forms.from"), "odd": F.col("_forms.odd")}).drop("_forms")
    parted = hold(formed, shown=F.when(F.col("_seen") != F.col("raw"), F.col("_seen")), direct=F.lower("_seen"),
                  swap_l=unswap(F.col("plain"), 0), swap_i=unswap(F.col("plain"), 1), parts=split_domain(F.col("plain")))
    return hold(parted, part_name=F.col("parts.name"), pieces=pieces(F.col("parts")))


def _own(text: Column) -> Column:
    return F.exists("own", lambda d: (text == d) | F.endswith(text, F.concat(F.lit("."), d)))


def candidates(names: DataFrame, watch: PinnedWatchlist, keys: list[str], own_on_raw: bool) -> DataFrame:
    """A row for each row of names and entry worth scoring, the entry's own names left out; nothing is shuffled."""
    spec = watch_keys(watch)
    own = F.broadcast(watch.table.select("watch_no", "own"))
    swap_l, swap_i, plain = F.col("swap_l"), F.col("swap_i"), F.col("plain")
    # Empty where a form adds nothing; the Arrow step then skips it.
    found = prepare(names).withColumn("found", name_proposals(spec)(
        plain, F.when(swap_l != plain, swap_l), F.when(swap_i != swap_l, swap_i), F.col("part_name"), F.col("pieces"), F.col("raw"), F.col("shown")))
    text = F.col("raw" if own_on_raw else "plain").alias("own_text")
    others = _everywhere(watch)
    every = F.concat("found", F.array_compact(F.array(*others))) if others else F.col("found")
    return found.select(*keys, "domain", text, F.inline(every)).join(own, "watch_no").filter(~_own(F.col("own_text"))).drop("own", "own_text")


# --- evidence ----------------------------------------------------------------

_BLANK = "named_struct(" + ", ".join(f"'{n}', CAST(NULL AS {t})" for n, t in EVIDENCE_FIELDS.items()) + ")"


def _evidence(reason: str, **fields: Column) -> Column:
    made = F.expr(_BLANK).withField("reason", F.lit(reason))
    for name, value in fields.items():
        made = made.withField(name, value)
    return made


def _origin(at: Column) -> Column:
    return F.when(F.col("origin").isNull(), at).otherwise(F.get("origin", at))


def _span(at: Column, length: Column) -> Column:
    return F.struct(_origin(at).cast("int").alias("from"), (_origin(at + length - 1) + 1).cast("int").alias("to"))


def _written_inside() -> Column:
    """The entry's domains found inside the name, in list order."""
    def look(d: Column) -> Column:
        dashed = F.replace(d, F.lit("."), F.lit("-"))
        return F.struct(d.alias("d"), dashed.alias("w"), (F.instr(F.col("plain"), d) - 1).alias("dots"),
                        (F.instr(F.col("plain"), dashed) - 1).alias("dashes"))

    found = F.transform(F.filter("own", lambda d: F.contains(d, F.lit("."))), look)
    return F.filter(found, lambda f: (f["dots"] >= 0) | (f["dashes"] >= 0))


def _inside_evidence(f: Column) -> Column:
    dots = _evidence("embedded-domain", domain=f["d"], form=F.lit("dots"), at=_span(f["dots"], F.length(f["d"])))
    dashes = _evidence("embedded-domain", domain=f["d"], form=F.lit("hyphens"), written=f["w"],
                       at=_span(f["dashes"], F.length(f["w"])))
    return F.when(f["dots"] >= 0, dots).otherwise(dashes)


def _read_words() -> Column:
    """Every proposed word with how the name writes it.

    ``at`` is where the folded name holds it, ``swap`` which unswapped form
    does and where, ``typo`` the first piece that misspells it.
    """
    proposed = F.filter("words", lambda w: w["bit"].bitwiseAND(F.col("seen").bitwiseOR(F.col("near"))) != 0)

    def plainly(w: Column) -> Column:
        at = find_word(F.col("plain"), w["word"])
        return F.struct(w["word"].alias("word"), w["len"].alias("len"), w["bit"].alias("bit"), at.alias("at"))

    def swapped(w: Column) -> Column:
        first = find_word(F.col("swap_l"), w["word"])
        second = find_word(F.col("swap_i"), w["word"])
        hit = F.struct(F.when(first >= 0, 0).when(second >= 0, 1).alias("variant"),
                       F.when(first >= 0, first).otherwise(second).alias("at"))
        direct = F.when(w["at"] >= 0, find_word(F.col("direct"), w["word"]))
        label = F.when(find_word(F.col("part_name"), w["word"]) < 0,
                       F.get(F.filter("parts.sub", lambda s: find_word(s, w["word"]) >= 0), F.lit(0)))
        return F.struct(
            w["word"].alias("word"), w["len"].alias("len"), w["bit"].alias("bit"), w["at"].alias("at"),
            direct.alias("direct"), F.when(w["at"] >= 0, label).alias("label"),
            F.when(w["at"] < 0, hit).alias("swap"))

    def misspelt(w: Column) -> Column:
        may = (w["at"] < 0) & w["swap"]["variant"].isNull() & ((w["len"] >= 5) | ((w["len"] == 4) & (F.size("lures") > 0)))
        return w.withField("typo", F.when(may, F.get(F.filter("near_typos", lambda t: t["word"] == w["word"]), F.lit(0))))

    return F.transform(F.transform(F.transform(proposed, plainly), swapped), misspelt)


def _word_score(w: Column) -> Column:
    keyword = fv.SCORE_KEYWORD + F.when(w["label"].isNotNull(), fv.SCORE_SUBDOMAIN_EXTRA).otherwise(0)
    typo = (F.when(w["typo"]["distance"] > 1, fv.SCORE_TYPO_TWO)
            .when(w["len"] >= 5, fv.SCORE_TYPO_ONE).otherwise(fv.SCORE_TYPO_ONE_SHORT))
    return (F.when((w["at"] >= 0) & (w["direct"] < 0), fv.SCORE_HOMOGLYPH)
            .when(w["at"] >= 0, keyword)
            .when(w["swap"]["variant"].isNotNull(), fv.SCORE_SWAP)
            .when(w["typo"].isNotNull(), typo))


def _swap_evidence(w: Column) -> Column:
    """Span and swaps of a word found in an unswapped form.

    The folded name is cut into the units that one letter of the unswapped
    form stands for, so positions map back by counting units.
    """
    variant, at = w["swap"]["variant"], w["swap"]["at"]
    units = F.regexp_extract_all(F.col("plain"), F.lit("(?s)" + "|".join(p for p, _ in fv.SWAP_PAIRS) + "|."), F.lit(0))

    def build(units: Column) -> Column:
        def width(first: Column, count: Column) -> Column:
            return F.aggregate(F.slice(units, first, count), F.lit(0), lambda n, u: n + F.length(u))

        start = width(F.lit(1), at)
        span = _span(start, width(at + 1, w["len"]))

        def unit(u: Column, i: Column) -> Column:
            to = F.when(variant == 0, unswap(u, 0)).otherwise(unswap(u, 1))
            return F.struct(_origin(width(F.lit(1), i)).cast("int").alias("at"), u.alias("from"), to.alias("to"))

        def inside(span: Column) -> Column:
            made = F.filter(F.transform(units, unit), lambda s: (s["from"] != s["to"]) & (s["at"] >= span["from"])
                            & (s["at"] < span["to"]))
            return _evidence("swap", word=w["word"], at=span, swaps=made)

        return let(span, inside)

    return let(units, build)


def _glyph_evidence(w: Column, at: Column) -> Column:
    return let(at, lambda span: _evidence("homoglyph", word=w["word"], at=span, chars=F.filter(
        F.col("odd"), lambda c: (c["at"] >= span["from"]) & (c["at"] < span["to"]))))


def _word_evidence(w: Column) -> Column:
    at = _span(w["at"], w["len"])
    keyword = _evidence("keyword", word=w["word"], at=at)
    typo = w["typo"]
    where = F.instr(F.col("plain"), typo["piece"]) - 1
    misspelt = _evidence("typo", word=w["word"], piece=typo["piece"], distance=typo["distance"],
                         at=F.when(where >= 0, _span(where, F.length(typo["piece"]))))
    return (F.when((w["at"] >= 0) & (w["direct"] < 0), F.array(_glyph_evidence(w, at)))
            .when((w["at"] >= 0) & w["label"].isNotNull(), F.array(_evidence("subdomain", label=w["label"]), keyword))
            .when(w["at"] >= 0, F.array(keyword))
            .when(w["swap"]["variant"].isNotNull(), F.array(_swap_evidence(w)))
            .when(typo.isNotNull(), F.array(misspelt))
            .otherwise(F.array().cast(f"array<{EVIDENCE}>")))


def _first_per_reason(rows: Column) -> Column:
    """Rows in order, the first of each reason kept."""
    def keep(kept: Column, row: Column) -> Column:
        known = F.exists(kept, lambda k: k["reason"] == row["reason"])
        return F.when(known, kept).otherwise(F.concat(kept, F.array(row)))

    return F.aggregate(rows, F.array().cast(f"array<{EVIDENCE}>"), keep)


def score_brands(rows: DataFrame) -> DataFrame:
    """Findings of prepared name x brand rows (own, endings, words, seen, near)."""
    nothing = F.array().cast(f"array<{EVIDENCE}>")
    looked = hold(
        rows, lures=lure_words(F.col("plain")), inside=_written_inside(),
        same_name=F.get(F.filter("endings", lambda e: e["name"] == F.col("part_name")), F.lit(0)))
    near = F.transform(F.filter("words", lambda w: w["bit"].bitwiseAND(F.col("near")) != 0), lambda w: w["word"])
    looked = looked.withColumn("near_typos", typos(F.when(F.col("near") != 0, near), F.col("pieces")))
    read = hold(looked, read=F.filter(_read_words(), lambda w: (w["at"] >= 0) | w["swap"]["variant"].isNotNull() | w["typo"].isNotNull()))
    based = hold(read, base=F.greatest(
        F.array_max(F.transform("inside", lambda f: F.when(f["dots"] >= 0, fv.SCORE_DOTS).otherwise(fv.SCORE_HYPHENS))),
        F.when(F.col("same_name").isNotNull(), fv.SCORE_ENDING), F.array_max(F.transform("read", _word_score)))
    ).filter(F.col("base").isNotNull())
    ending = _evidence("tld-swap", name=F.col("part_name"), ending=F.col("parts.suffix"), real=F.col("same_name.real"))
    basis = F.concat(
        F.transform(F.slice("inside", 1, 1), _inside_evidence),
        F.when(F.col("same_name").isNotNull(), F.array(ending)).otherwise(nothing),
        F.flatten(F.transform("read", _word_evidence)),
    )
    lure = _evidence("lure-word", words=F.transform("lures", lambda h: h["word"]),
                     spans=F.transform("lures", lambda h: _span(h["at"], h["len"])))
    has_lure, coded = F.size("lures") > 0, F.contains("raw", F.lit("xn--"))
    extra = F.when(has_lure, fv.SCORE_LURE_EXTRA).otherwise(0) + F.when(coded, fv.SCORE_IDN_EXTRA).otherwise(0)
    return hold(
        based, score=F.least(F.lit(fv.SCORE_MAX), F.col("base") + extra).cast("int"),
        evidence=F.concat(
            _first_per_reason(basis), F.when(has_lure, F.array(lure)).otherwise(nothing),
            F.when(coded, F.array(_evidence("idn", ascii=F.col("raw")))).otherwise(nothing)))


def score_patterns(rows: DataFrame) -> DataFrame:
    """Findings of prepared name x pattern rows."""
    regex = F.concat(F.lit("(?iu)"), F.col("pattern"))
    on = F.when(F.regexp_like("raw", regex), "ascii").when(F.regexp_like("shown", regex), "unicode")
    text = F.when(F.col("on") == "ascii", F.col("raw")).otherwise(F.col("shown"))
    start = F.regexp_instr(text, regex) - 1
    stop = start + F.length(F.regexp_substr(text, regex))
    at = F.struct(start.alias("from"), stop.alias("to"))
    return (
        rows.withColumn("on", on).filter(F.col("on").isNotNull())
        .withColumn("score", F.col("pattern_score").cast("int"))
        .withColumn("evidence", F.array(_evidence("pattern", pattern=F.col("pattern"), on=F.col("on"), at=at)))
    )


def _finding(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.select(
        *keys, "watch", "domain", F.col("shown").alias("unicode"), "score", severity_of(F.col("score")).alias("severity"),
        F.transform("evidence", lambda e: e["reason"]).alias("reasons"), "evidence")


# --- public ------------------------------------------------------------------

def detect(names: DataFrame, watch: CompiledWatchlist | PinnedWatchlist, keys: tuple[str, ...] = (),
           own_on_raw: bool = False) -> DataFrame:
    """Findings of every name in ``domain`` against the watchlist.

    ``keys`` are columns that tell rows of the same name apart (a certificate
    and the position on it); without them equal names give one finding per
    entry. ``own_on_raw`` compares a brand's own domains with the name as
    written instead of its folded form, so an exact look-alike of the real
    domain is reported too.
    """
    pinned = watch if isinstance(watch, PinnedWatchlist) else pin(watch)
    keys = list(keys)
    if pinned.empty:
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields if f.name in keys)
        return names.sparkSession.createDataFrame([], f"{kept + ', ' if kept else ''}{FINDING}")
    proposed, scored = _scored(names, pinned, keys, own_on_raw)
    if not keys:
        return scored.drop("watch_no")
    # One row per name and entry on the scored side: a name that fills the
    # other side is split by adaptive skew handling.
    joined = proposed.distinct().join(scored, ["domain", "watch_no"])
    return joined.select(*keys, *[c for c in scored.columns if c != "watch_no"])


def _scored(names: DataFrame, pinned: PinnedWatchlist, keys: list[str], own_on_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of names with the entries they are worth scoring for (keys, domain, watch_no), and the findings of each distinct name and entry."""
    # Read by the scoring and by the rows that get its findings.
    proposed = stored(candidates(names.select(*keys, "domain"), pinned, keys, own_on_raw), "proposed")
    # Each distinct name is scored once; rows of the same name share its findings.
    rows = proposed.groupBy("domain", "watch_no").agg(F.bit_or("seen").alias("seen"), F.bit_or("near").alias("near"))
    rows = prepare(rows.join(F.broadcast(pinned.table), "watch_no"))
    found = []
    if pinned.words or pinned.domains:
        found.append(_finding(score_brands(rows.filter(F.col("watch.kind") == "brand")), ["watch_no"]))
    if pinned.patterns:
        found.append(_finding(score_patterns(rows.filter(F.col("watch.kind") == "pattern")), ["watch_no"]))
    scored = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return proposed.select(*keys, "domain", "watch_no"), scored


def strongest(names: DataFrame, watch: CompiledWatchlist | PinnedWatchlist, cert: tuple[str, ...], position: str = "pos") -> DataFrame:
    """``best_per_certificate`` of ``detect``, without position and watch_id.

    Which finding is the strongest is found out over scores alone; what it says is added to it afterwards, so that
    what the others say is not shuffled.
    """
    pinned = watch if isinstance(watch, PinnedWatchlist) else pin(watch)
    keys = [*cert, position]
    if pinned.empty:
        return best_per_certificate(detect(names, pinned, tuple(keys)), cert, position).drop(position, "watch_id")
    proposed, findings = _scored(names, pinned, keys)
    scored = stored(findings, "scored")
    scores = scored.select("domain", "watch_no", "score", F.struct("watch.id").alias("watch"))
    # A row that is there twice is the same choice.
    best = best_per_certificate(proposed.join(scores, ["domain", "watch_no"]), cert, position)
    chosen = stored(best.select(*cert, "domain", "watch_no"), "strongest")
    return chosen.join(scored, ["domain", "watch_no"]).select(*cert, *[c for c in scored.columns if c != "watch_no"])


def best_per_certificate(findings: DataFrame, cert: tuple[str, ...], position: str = "pos") -> DataFrame:
    """The strongest finding per certificate and entry; the earlier name wins ties."""
    kept = [c for c in findings.columns if c not in cert]
    order = F.struct(F.col("score"), -F.col(position))
    return (
        findings.groupBy(*cert, F.col("watch.id").alias("watch_id"))
        .agg(F.max_by(F.struct(*kept), order).alias("best"))
        .select(*cert, "watch_id", "best.*")
    )


def check_names(inputs: DataFrame, watch: CompiledWatchlist | PinnedWatchlist, text: str = "input") -> DataFrame:
    """Findings of pasted names or links; inputs without a match stay, with nulls."""
    hosts = (
        inputs.withColumn("_host", host_text(F.col(text)))
        .withColumn("domain", F.coalesce(ascii_host(F.col("_host")), F.lit(""))).drop("_host")
    )
    found = detect(hosts.filter(F.col("domain") != "").select("domain"), watch)
    return hosts.join(found, "domain", "left")
