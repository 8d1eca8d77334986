"""Benchmark decontamination by an FM-index of every shard of documents.

A shard is a run of documents in one task. Its words become symbols of the
benchmark's vocabulary; every stretch of other words, and every end of a
document, is one separator, as no window can cross it. The suffixes of that
text are sorted, its Burrows-Wheeler transform is held in a wavelet matrix, and
all windows of all items are searched backwards at once by wavelet ranks.
Rows that match walk back to a sampled suffix, which gives their place.
Documents are never shuffled; of the benchmark a bounded block is broadcast at
a time and further blocks are further steps over the same rows.

Nulls: a null text has no words. An item without words has no window; an item
without id marks words but is not listed. Items with equal ids count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import extend, quoted, shipped, struct, total_bytes
from .text import ALNUM, Words, words

SEPARATOR = 0
SAMPLE_EVERY = 8
#: Bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 32 << 20



# ---- the index of one shard


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Place of each suffix in sorted order. Separators sort first and by position, so no two suffixes are equal."""
    n = len(symbols)
    gap = symbols == SEPARATOR
    gaps = int(gap.sum())
    size = np.bincount(symbols, minlength=1)
    size[SEPARATOR] = gaps
    rank = (np.cumsum(size) - size)[symbols]
    rank[gap] = np.arange(gaps)
    open_ = np.flatnonzero((size[symbols] > 1) & ~gap)
    step = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[open_ + step]
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        old = key // (n + 1)
        place = np.arange(len(key))
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_old = np.r_[True, old[1:] != old[:-1]]
        first_key = np.maximum.accumulate(np.where(new_key, place, 0))
        first_old = np.maximum.accumulate(np.where(new_old, place, 0))
        rank[open_] = old + first_key - first_old
        alone = new_key & np.r_[new_key[1:], True]
        open_ = open_[~alone]
        step *= 2
    return rank


class Wavelet:
    """Ranks and symbols of a sequence, a bit of the symbol at a level."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            ones = (values >> bit) & 1
            ranks = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            zeros = len(values) - int(ranks[-1])
            self.levels.append((bit, ranks, zeros))
            one = ones.astype(bool)
            values = np.concatenate([values[~one], values[one]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ranks, zeros in self.levels:
            ones = ranks[at]
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, ranks, zeros in self.levels:
            ones = ranks[at]
            one = ranks[at + 1] > ones
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return out


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = len(symbols)
        rank = suffix_ranks(symbols)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        before = symbols[suffix - 1]  # of the first suffix: the last symbol, a separator
        self.n = n
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.wavelet = Wavelet(before, alphabet - 1)
        self.bottom = self.wavelet.down(np.arange(alphabet), np.zeros(alphabet, np.int64))
        # A walk back ends at the latest where a stretch of words begins, so it never steps over a separator.
        sampled = (suffix % SAMPLE_EVERY == 0) | (before == SEPARATOR)
        self.sampled = np.zeros(n + 1, np.int64)
        np.cumsum(sampled, out=self.sampled[1:])
        self.samples = suffix[sampled]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.wavelet.down(symbol, row) - self.bottom[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which patterns (rows, filled with -1 in front) occur, and their rows of the index from and to."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, column]
            on = symbol >= 0
            low[on], high[on] = self.step(symbol[on], low[on]), self.step(symbol[on], high[on])
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        found = np.empty(len(row), np.int64)
        todo, back = np.arange(len(row)), 0
        while len(todo):
            here = self.sampled[row + 1] > self.sampled[row]
            found[todo[here]] = self.samples[self.sampled[row[here]]] + back
            todo, row = todo[~here], row[~here]
            row = self.step(self.wavelet.symbol(row), row)
            back += 1
        return found


# ---- the benchmark


@dataclass
class Phrases:
    """Windows of a block of items: symbols by row, and the items of each. `vocabulary`: the words, as bytes."""

    vocabulary: pa.Array
    patterns: np.ndarray
    length: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    names: list[str]


def phrases(rows: list[tuple[str | None, str | None]], window: int) -> Phrases:
    names = sorted({i for i, _ in rows if i is not None})
    place = {name: k for k, name in enumerate(names)}
    w = words(pa.array([t for _, t in rows], pa.large_string()), ALNUM, True)
    coded = w.array().dictionary_encode()
    vocabulary, symbol = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1
    seen: dict[bytes, set[int]] = {}
    for d, (item, _) in enumerate(rows):
        own = symbol[w.first[d]:w.first[d + 1]]
        for k in range(max(1, len(own) - window + 1) if len(own) else 0):
            owners = seen.setdefault(own[k:k + window].tobytes(), set())
            if item is not None:
                owners.add(place[item])
    patterns = np.full((len(seen), window), -1, np.int64)
    length = np.zeros(len(seen), np.int64)
    for k, key in enumerate(seen):
        own = np.frombuffer(key, symbol.dtype)
        length[k] = len(own)
        patterns[k, window - len(own):] = own
    first = np.cumsum([0, *[len(x) for x in seen.values()]])
    owner = np.array([i for x in seen.values() for i in sorted(x)], np.int64)
    return Phrases(vocabulary, patterns, length, first, owner, names)


# ---- a shard against a block


def occurrences(w: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur: the window's number and the first of its words in the shard."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(w) or not len(p.vocabulary):
        return nothing
    symbol = pc.index_in(w.array(), value_set=p.vocabulary).fill_null(SEPARATOR - 1).to_numpy().astype(np.int64) + 1
    # A separator after each document, then one for every stretch of separators.
    ends = w.first[1:][w.counts > 0]
    symbol = np.insert(symbol, ends, SEPARATOR)
    word = np.insert(np.arange(len(w)), ends, -1)
    keep = (symbol != SEPARATOR) | np.r_[True, symbol[:-1] != SEPARATOR]
    symbol, word = symbol[keep], word[keep]
    if len(symbol) < 2:
        return nothing
    index = FMIndex(symbol, len(p.vocabulary) + 1)
    which, low, high = index.search(p.patterns)
    many = high - low
    row = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    return np.repeat(which, many), word[index.locate(row)]


def merged(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true: from and to."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def shard_hits(w: Words, p: Phrases) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which words are hit; of each document the items found."""
    which, at = occurrences(w, p)
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + p.length[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(w.first, at, side="right") - 1
    pair = np.unique(doc * max(len(p.length), 1) + which)
    doc, which = pair // max(len(p.length), 1), pair % max(len(p.length), 1)
    many = p.first[which + 1] - p.first[which]
    owner = p.owner[np.repeat(p.first[which] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))] if len(which) else which
    pair = np.unique(np.repeat(doc, many) * max(len(p.names), 1) + owner)
    doc, owner = pair // max(len(p.names), 1), pair % max(len(p.names), 1)
    return hit, np.split(owner, np.searchsorted(doc, np.arange(1, len(w.first) - 1)))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with `n_words`, `spans` (merged word ranges to remove) and `items` (sorted ids as text, of windows found).

    A column of the same name is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("i"), F.col(quoted(item_text)).cast("string").alias("t"))
    blocks = max(1, -(-total_bytes(items, "t") // block_bytes))
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "spans", "items")]
    out = docs.select(*[quoted(c) for c in own], F.col(quoted(text)).cast("string").alias("__t"),
                      F.lit(0).cast("long").alias("__n_words"),
                      F.array().cast("array<struct<begin:int,end:int>>").alias("__hits"), F.array().cast("array<string>").alias("__items"))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        sent = shipped(spark, phrases([(r.i, r.t) for r in part.toLocalIterator()], window))
        out = _against(out, sent, own)
    named = [F.col("__n_words").alias("n_words"), F.col("__hits").alias("spans"), F.col("__items").alias("items")]
    return out.select(*[quoted(c) for c in own], *named)


def _against(df: DataFrame, sent, keep: list[str]) -> DataFrame:
    """One step: what an earlier block found is in the row and is merged with what this one finds."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        p: Phrases = sent()
        w = words(batch.column("__text"), ALNUM, True)
        hit, found = shard_hits(w, p)
        had = batch.column("__had")
        for d, old in enumerate(had.field("__hits").to_pylist()):
            for s in old or ():
                hit[w.first[d] + s["begin"]:w.first[d] + s["end"]] = True
        # Runs must not join over the end of a document.
        begin, end = [], []
        begin_all, end_all = merged(hit)
        cut = np.unique(np.r_[begin_all, w.first[:-1][w.counts > 0][hit[w.first[:-1][w.counts > 0]]]]) if len(hit) else begin_all
        begin = cut
        stop = np.r_[begin[1:], len(hit)]
        end = np.minimum(stop, end_all[np.searchsorted(end_all, begin, side="right")]) if len(begin) else begin
        doc = np.searchsorted(w.first, begin, side="right") - 1
        offsets = np.searchsorted(doc, np.arange(len(w.first))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array((begin - w.first[doc]).astype(np.int32)), pa.array((end - w.first[doc]).astype(np.int32))], ["begin", "end"])
        old_items = had.field("__items").to_pylist()
        items = [sorted({*(old_items[d] or ()), *(p.names[i] for i in own)}) for d, own in enumerate(found)]
        return [batch.column("__text"), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(items, pa.list_(pa.string()))]

    packed = df.select(*[quoted(c) for c in keep], F.col("__t"), F.struct("__hits", "__items").alias("__had"))
    return extend(packed, "__t", make, struct("__t string, __n_words bigint, __hits array<struct<begin:int,end:int>>, __items array<string>"),
                  size=1_000_000, keep=[*keep, "__had"]).drop("__had")


def hit_words(spans="spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["begin"]).cast("long"))


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`mark` with n_hit and contaminated: a twentieth of a document's words or more are hit."""
    out = mark(docs, benchmark, **options).withColumn("n_hit", hit_words())
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: The contract as DuckDB SQL, for tables of a few million words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS s FROM b, unnest(range(1, greatest(len(ws) - 11, 2))) t(i) WHERE len(ws) > 0),
windows AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM phrases) l, unnest(range(1, len(ws) - n + 2)) t(i)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrases USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found) f, unnest(range(n)) r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS listed FROM found WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
