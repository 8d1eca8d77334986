"""Language identification by interpolated Kneser-Ney character models.

All training rows are counted: each task counts the n-grams of its texts, Spark
adds them up per language. From the counts of the highest order follow those of
the lower ones (in how many ways a gram is continued to the left), discounts and
back-off weights, all by Spark. The log probability of a character is a sum over its
grams and contexts of all lengths (see `terms`), so the table of their hashes
and values is cut into blocks of about BLOCK_TERMS anywhere between two hashes, and
a batch of texts adds up block by block. A text gets the language
of the lowest cross-entropy per character; its score is the share of that
language when cross-entropies become odds at a fitted temperature, and `accepted`
says whether the cross-entropy is within what all of the language's own training texts show.

The order is the same whatever the size of the input: the number of blocks grows, and the driver
and a worker hold a bounded number of them. Letters are lower-cased; anything else is one space.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows without
language, or held out, teach nothing. Without any training row all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .frames import crc_mod, extend, quoted, saved, small_batches, struct
from .text import mix, slices

ORDER = 4
#: Terms in one block of the models, and blocks that a worker keeps between batches.
BLOCK_TERMS, KEPT_BLOCKS = 1_000_000, 3
#: Among these the temperature is chosen.
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 128)
UNKNOWN = "und"
SPACE = 0x20

_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _TABLE:
        table = np.full(0x110000, SPACE, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def codes(array: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, `order` - 1 spaces before and one behind each; and where each begins. Runs of spaces are one."""
    texts = [t or "" for t in array.to_pylist()]
    length = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = letters()[raw]
    ends = np.cumsum(length)
    # A space behind each text also keeps the runs of two texts apart.
    flat = np.insert(folded, ends, SPACE)
    first = np.r_[0, ends + np.arange(1, len(ends) + 1)]
    is_first = np.zeros(len(flat) + 1, bool)
    is_first[first] = True
    keep = (flat != SPACE) | np.r_[True, flat[:-1] != SPACE] | is_first[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    flat, first = flat[keep], place[first]
    pad = np.repeat(first[:-1], order - 1)
    flat = np.insert(flat, pad, SPACE)
    return flat, first + np.arange(len(first)) * (order - 1)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the grams whose characters are the columns; the order takes part."""
    h = np.full(len(columns[0]) if columns else 1, len(columns) + 1, np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return h


def context_hash(h: np.ndarray) -> np.ndarray:
    """Hash of what is seen as a context, from its hash as a gram."""
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


# ---- counts


def gram_counts(docs: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """(lang, g: the characters as text, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}

        def flush(name: str) -> pa.RecordBatch:
            grams, n = (np.concatenate(x) for x in zip(*total.pop(name), strict=True))
            grams, at = np.unique(grams, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(str).tolist()), pa.array(n)], ["lang", "g", "n"])

        for batch in slices(batches, "t"):
            names = batch.column("lang").to_pylist()
            for name in sorted(set(names)):
                part = batch.filter(pa.array([x == name for x in names]))
                flat, first = codes(part.column("t"), order)
                # Every character after the padding of its text ends one gram.
                end = np.ones(len(flat), bool)
                for k in range(order - 1):
                    end[np.minimum(first[:-1] + k, len(flat) - 1)] = False
                at = np.flatnonzero(end)
                view = np.stack([flat[at - order + 1 + k] for k in range(order)], 1).astype(np.uint32)
                key = gram_hash([view[:, k] for k in range(order)])
                _, one, n = np.unique(key, return_index=True, return_counts=True)
                grams = np.ascontiguousarray(view[one]).view(f"<U{order}").ravel()
                held = total.setdefault(name, [])
                held.append((grams, n))
                if sum(len(g) for g, _ in held) > 400_000:
                    rows = flush(name)
                    if rows.num_rows > 200_000:
                        yield rows
                    else:
                        total[name] = [(np.array(rows.column(1).to_pylist(), f"<U{order}"), rows.column(2).to_numpy())]
        for name in list(total):
            yield flush(name)

    rows = docs.select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).cast("string").alias("t")).mapInArrow(run, "lang string, g string, n bigint")
    return rows.groupBy("lang", "g").agg(F.sum("n").alias("n"))


# ---- models of one language, in memory: the plain version that the blocks are checked against


@dataclass
class Characters:
    """Sorted hashes of grams with log probabilities, and of contexts with log back-off weights."""

    gram: np.ndarray
    logp: np.ndarray
    context: np.ndarray
    backoff: np.ndarray
    order: int
    unseen: float

    def log_probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last character of each gram after the others."""
        out, open_, add = np.full(len(columns[0]), self.unseen), np.arange(len(columns[0])), np.zeros(len(columns[0]))
        for k in range(self.order):
            own = [c[open_] for c in columns[k:]]
            value, hit = _find(self.gram, self.logp, gram_hash(own))
            out[open_[hit]] = add[hit] + value[hit]
            open_, add, own = open_[~hit], add[~hit], [c[~hit] for c in own]
            if not len(open_):
                return out
            if len(own) > 1:
                value, hit = _find(self.context, self.backoff, gram_hash(own[:-1]))
                add = add + np.where(hit, value, 0.0)
        out[open_] = add + self.unseen
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def _grouped(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of characters, the sums of n and how many rows each stands for."""
    key = gram_hash([rows[:, k] for k in range(rows.shape[1])]) if rows.shape[1] else np.zeros(len(rows), np.uint64)
    _, one, at = np.unique(key, return_index=True, return_inverse=True)
    return rows[one], np.bincount(at, n), np.bincount(at)


def kneser_ney(rows: np.ndarray, n: np.ndarray) -> Characters:
    """From the distinct grams of the highest order (grams x characters) and their counts."""
    order = rows.shape[1]
    levels = [(rows, n.astype(float))]
    for _ in range(order - 1):
        shorter, _, kinds = _grouped(levels[-1][0][:, 1:], np.ones(len(levels[-1][0])))
        levels.append((shorter, kinds.astype(float)))
    letters_ = len(levels[-1][0]) + 1
    unseen = None
    grams, logs, contexts, backs = [], [], [], []
    lower: Characters | None = None
    for rows_k, c in reversed(levels):
        k = rows_k.shape[1]
        once, twice = (c == 1).sum(), (c == 2).sum()
        d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once and twice else 0.5
        if k == 1:
            # No context: what the discount frees is spread evenly over the letters and one that was never seen.
            spread = d * len(c) / c.sum() / letters_
            p = np.maximum(c - d, 0) / c.sum() + spread
            unseen = float(np.log(spread))
        else:
            context, total, kinds = _grouped(rows_k[:, :-1], c)
            back = d * kinds / total
            key = gram_hash([context[:, i] for i in range(k - 1)])
            place = np.argsort(key)
            at = place[np.searchsorted(key[place], gram_hash([rows_k[:, i] for i in range(k - 1)]))]
            below = np.exp(lower.log_probability([rows_k[:, i] for i in range(1, k)]))
            p = np.maximum(c - d, 0) / total[at] + back[at] * below
            contexts.append(key)
            backs.append(np.log(back))
        grams.append(gram_hash([rows_k[:, i] for i in range(k)]))
        logs.append(np.log(p))
        g, ctx = np.concatenate(grams), np.concatenate(contexts) if contexts else np.zeros(0, np.uint64)
        go, co = np.argsort(g), np.argsort(ctx)
        lower = Characters(g[go], np.concatenate(logs)[go], ctx[co], (np.concatenate(backs) if backs else np.zeros(0))[co], k, unseen)
    return lower


# ---- models as blocks


def terms(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """From the counts of the highest order: (lang, g, is_context, value) and (lang, unseen).

    The log probability of a character is `unseen`, and for each length the value of the context
    before it (the log of its back-off weight) and of the gram that it ends (by how much its log
    probability exceeds that of back-off and shorter gram); what was never seen adds 0.
    """
    levels = [counts.select("lang", "g", F.col("n").cast("double").alias("c"))]
    for k in range(order - 1, 0, -1):
        levels.append(saved(levels[-1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).cast("double").alias("c"))))
    found, lower, unseen = [], None, None
    for k, level in enumerate(reversed(levels), 1):
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        d = F.when((once > 0) & (twice > 0), F.greatest(F.least(once / (once + 2 * twice), F.lit(0.9)), F.lit(0.1))).otherwise(0.5)
        # One row per language.
        stats = F.broadcast(level.groupBy("lang").agg(d.alias("d"), F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total")))
        left = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if k == 1:
            # No context: what the discount frees is spread evenly over the letters and one that was never seen.
            spread = F.col("d") * F.col("kinds") / F.col("total") / (F.col("kinds") + 1)
            unseen = stats.select("lang", F.log(spread).alias("unseen"))
            made = level.join(stats, "lang").select("lang", "g", (left + spread).alias("p"), spread.alias("base"))
        else:
            cut = level.withColumn("h", F.substring("g", 1, k - 1)).withColumn("s", F.substring("g", 2, k - 1))
            contexts = cut.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"))
            contexts = saved(contexts.join(stats.select("lang", "d"), "lang").select("lang", "h", "total", "d", (F.col("d") * F.col("n") / F.col("total")).alias("back")))
            found.append(contexts.select("lang", F.col("h").alias("g"), F.lit(True).alias("is_context"), F.log("back").alias("value")))
            base = F.col("back") * F.col("below")
            below = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
            made = cut.join(contexts, ["lang", "h"]).join(below, ["lang", "s"]).select("lang", "g", (left + base).alias("p"), base.alias("base"))
        lower = saved(made)
        found.append(lower.select("lang", "g", F.lit(False).alias("is_context"), F.log(F.col("p") / F.col("base")).alias("value")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, unseen


@dataclass
class Block:
    """Sorted hashes; of hash i: languages and values from start[i] to start[i + 1]."""

    key: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the wanted hashes that are known: their place, and a language and value."""
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        place = np.flatnonzero(self.key[at] == wanted)
        n = self.start[at[place] + 1] - self.start[at[place]]
        pick = np.repeat(self.start[at[place]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(place, n), self.lang[pick], self.value[pick]


def blocks(found: DataFrame, names: list[str], each: int = BLOCK_TERMS) -> list[Broadcast]:
    """The terms in blocks by their hash; one after the other passes through the driver."""
    spark = found.sparkSession
    many = -(-found.count() // each)
    number = {x: i for i, x in enumerate(names)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.array(batch.column("g").to_pylist(), object)
            size = np.array([len(g) for g in grams], np.int64)
            key = np.zeros(len(grams), np.uint64)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                chars = np.array(grams[at].tolist(), f"<U{k}").view(np.uint32).reshape(len(at), k)
                key[at] = gram_hash([chars[:, i] for i in range(k)])
            context = batch.column("is_context").to_numpy(zero_copy_only=False)
            key = np.where(context, context_hash(key), key)
            langs = pa.array([number[x] for x in batch.column("lang").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(many)).astype(np.int32)), pa.array(key.view(np.int64)), langs, batch.column("value")], ["block", "key", "lang", "value"])

    def packed(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().view(np.uint64)
        lang, order = table.column("lang").to_numpy(), np.lexsort((table.column("lang").to_numpy(), key))
        parts = [key[order].tobytes(), lang[order].tobytes(), table.column("value").to_numpy()[order].tobytes()]
        return pa.table({"block": table.column("block")[:1], **{c: pa.array([x], pa.binary()) for c, x in zip("klv", parts, strict=True)}})

    rows = saved(found.mapInArrow(hashed, "block int, key bigint, lang int, value double").groupBy("block").applyInArrow(packed, "block int, k binary, l binary, v binary"))
    sent = []
    for b in range(many):
        for row in rows.where(F.col("block") == b).collect():
            key, start = np.unique(np.frombuffer(row.k, np.uint64), return_index=True)
            # Plain arrays: workers need not know this module's classes to read them.
            sent.append(spark.sparkContext.broadcast((key, np.r_[start, len(row.k) // 8], np.frombuffer(row.l, np.int32), np.frombuffer(row.v, np.float64))))
    return sent


@dataclass
class Languages:
    names: list[str]
    unseen: np.ndarray
    blocks: list[Broadcast]
    order: int
    temperature: float
    limit: np.ndarray

    def entropies(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character, texts x languages; and whether a text has a letter."""
        flat, first = codes(array, self.order)
        end = np.ones(len(flat), bool)
        for k in range(self.order - 1):
            end[np.minimum(first[:-1] + k, len(flat) - 1)] = False
        at = np.flatnonzero(end)
        columns = [flat[at - self.order + 1 + k] for k in range(self.order)]
        key = gram_hash(columns) if len(at) else np.zeros(0, np.uint64)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        columns = [c[one] for c in columns]
        # Of each gram: the grams that end it, of all lengths, and the contexts before its last character.
        wanted = [gram_hash(columns[k:]) for k in range(self.order)] + [context_hash(gram_hash(columns[k:-1])) for k in range(self.order - 1)]
        wanted, which = np.unique(np.concatenate(wanted), return_inverse=True) if len(one) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hits = []
        for i, sent in enumerate(self.blocks if len(one) else []):
            hits.append(Block(*sent.value).find(wanted))
            if i >= KEPT_BLOCKS:
                # The worker would keep it; it is read again from the executor's disk.
                sent.__dict__.pop("_value", None)
        place, lang, value = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
        sort = np.argsort(lang, kind="stable")
        place, value, bounds = place[sort], value[sort], np.searchsorted(lang[sort], np.arange(len(self.names) + 1))
        texts = len(first) - 1
        doc = np.searchsorted(first, at, side="right") - 1
        length = np.bincount(doc, minlength=texts)
        out = np.empty((texts, len(self.names)))
        for j in range(len(self.names)):
            own = np.zeros(len(wanted))
            own[place[bounds[j]:bounds[j + 1]]] = value[bounds[j]:bounds[j + 1]]
            logs = own[which].reshape(-1, len(one)).sum(0)[back] if len(one) else np.zeros(0)
            out[:, j] = -(np.bincount(doc, logs, texts) + self.unseen[j] * length) / np.maximum(length, 1)
        has = np.concatenate([[0], np.cumsum(flat != SPACE)])
        return out, (has[first[1:]] - has[first[:-1]]) > 0

    def predict(self, array: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(array), np.zeros(len(array)), np.zeros(len(array), bool)
        h, letter = self.entropies(array)
        best = h.argmin(1)
        lowest = h[np.arange(len(h)), best]
        share = 1 / np.exp(np.clip(-(h - lowest[:, None]) * self.temperature, -700, 0)).sum(1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, share, 0.0), letter & (lowest <= self.limit[best])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, block_terms: int = BLOCK_TERMS) -> Languages:
    """Learn from all rows with a language whose id is not held out (crc32 of it modulo 3 is 1)."""
    small_batches(docs.sparkSession)
    may = docs.where((crc_mod(doc_id, 3) != 1) & F.col(quoted(lang)).isNotNull()).select(
        F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).cast("string").alias("t"), F.col(quoted(lang)).cast("string").alias("lang"))
    found, unseen = terms(saved(gram_counts(may.where("t IS NOT NULL"), "t", "lang", order)), order)
    least = sorted(tuple(r) for r in unseen.collect())
    names = [r[0] for r in least]
    model = Languages(names, np.array([r[1] for r in least]), blocks(found, names, block_terms), order, 10.0, np.full(len(names), np.inf))
    return _calibrated(model, may) if names else model


def _calibrated(model: Languages, rows: DataFrame) -> Languages:
    """Over all rows: temperature by likelihood of the own language; limits three deviations above a language's mean cross-entropy.

    A language none of whose rows has a letter shows nothing, and no text is accepted as of it.
    """
    number = {x: i for i, x in enumerate(model.names)}

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        h, letter = model.entropies(batch.column("__text"))
        # A language with null texts only has no model, and its rows no letter.
        own = (np.arange(len(h)), np.array([number.get(x, 0) for x in batch.column("lang").to_pylist()], np.int64))
        above = h.min(1, keepdims=True) - h
        fits = [t * above[own] - np.log(np.exp(np.maximum(t * above, -700)).sum(1)) for t in TEMPERATURES]
        return [pa.array(h[own]), pa.array(letter), *[pa.array(f) for f in fits]]

    fits = [f"fit{t}" for t in TEMPERATURES]
    found = extend(rows, "t", make, struct(", ".join(["h double, letter boolean", *[f"{f} double" for f in fits]])), keep=["lang"]).where("letter")
    shown = found.groupBy("lang").agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("deviation"), *[F.sum(f).alias(f) for f in fits]).collect()
    limit = np.full(len(model.names), -np.inf)
    for r in shown:
        limit[number[r.lang]] = r["mean"] + 3 * r.deviation + 0.05
    best = max(range(len(fits)), key=lambda i: sum(r[fits[i]] for r in shown))
    return replace(model, temperature=float(TEMPERATURES[best]), limit=limit)


def predict(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred, score (0 to 1) and accepted. Columns of these names are replaced."""
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        names, score, accepted = model.predict(batch.column("__text"))
        return [pa.array(names, pa.string()), pa.array(score), pa.array(accepted)]

    return extend(docs, text, make, struct("lang_pred string, score double, accepted boolean"), keep=keep)
