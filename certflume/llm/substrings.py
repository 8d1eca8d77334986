"""Exact substring deduplication by suffix automata of reference shards.

A window of `window` words is removed from a document if its words also start in a document
with a smaller id. The reference is the corpus itself and has no size bound, so
automata are not broadcast whole: windows are routed to the one shard that can
hold them, by their minimizer (the least hash of the `gram`-word grams inside),
which equal windows share.

1. Every document gives its minimizers. Per hash, task by task first, it is
   found out which occur in two documents or more; the others are done with. Also,
   which are hot: their passages would not fit one automaton.
2. Around a shared minimizer the words of all windows that have it are one
   passage. Passages go to the shard of the hash, equal ones of a group of documents once.
   Around a hot minimizer each window goes by itself to the shard of its own hash (two
   hashes of 64 bits stand for its words), so only equal windows meet, those of a group as one.
3. A shard's passages become suffix automata whose states know the smallest id that
   holds them. Each passage is streamed through the automaton of its shard; where the match
   is `window` words long, the state (by suffix links, the one of that length) tells whose
   the words were first. Of a hot minimizer's windows the smallest id is taken directly.
4. The maximal spans return to their documents and are merged.

No list of a hot passage's documents exists anywhere: what a task sends for a
passage, and what comes back, is one entry for a task or group of documents.

Nulls: a null text has no words. Rows with a null id come after all ids: they are
checked, and nothing is removed because of them. Rows with one id are one document's worth: they never
remove words from each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import partitions_for, quoted, struct, total_bytes
from .text import CHECK_SEED, SPACED, Words, mix, slices, string_bytes, window_hashes, within, words

WINDOW, GRAM = 13, 5
#: Id of rows without one.
LAST = (1 << 63) - 1
#: Text bytes in a group of documents, minimizers in a message of a task, words in one automaton.
GROUP_BYTES, TASK_HASHES, SHARD_WORDS = 16 << 20, 400_000, 40_000
#: Counts of minimizers end here.
MOST = (1 << 16) - 1
#: Windows of hot minimizers, and what is answered of a passage or window.
WINDOWS = np.dtype([("key", np.uint64), ("check", np.uint64), ("low", np.int64), ("high", np.int64)])
RUNS = np.dtype([("key", np.uint64), ("holder", np.int64), ("from", np.uint16), ("to", np.uint16)])


# ---- passages of a batch


@dataclass
class Passages:
    """Per minimizer occurrence: its hash, document, and the words from `begin` to `end` of all windows that have it."""

    hash: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def passages(w: Words, word_hash: np.ndarray, window: int, gram: int) -> Passages:
    starts = within(w, window)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return Passages(np.zeros(0, np.uint64), e, e, e)
    grams = window_hashes(word_hash, gram)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = view[starts].argmin(1) + starts
    # Consecutive windows with one minimizer are one passage.
    new = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    doc = np.searchsorted(w.first, starts[first], side="right") - 1
    return Passages(grams[place[first]], doc, starts[first], starts[last] + window)


# ---- step 1: minimizers that two documents share


def _minimizers(rows: DataFrame, shards: int, window: int, gram: int) -> DataFrame:
    """Per task and shard: distinct (hash, group of documents) with the least and largest id, and how often (MOST at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("hash", np.uint64), ("p", np.int32), ("low", np.int64), ("high", np.int64), ("n", np.uint16)])
        held: list[np.ndarray] = []
        size = 0

        def merged() -> np.ndarray:
            a = np.concatenate(held)
            a = a[np.lexsort((a["p"], a["hash"]))]
            begin = np.flatnonzero(np.r_[True, (a["hash"][1:] != a["hash"][:-1]) | (a["p"][1:] != a["p"][:-1])]) if len(a) else np.zeros(0, np.int64)
            out = a[begin]
            if len(a):
                out["low"], out["high"] = np.minimum.reduceat(a["low"], begin), np.maximum.reduceat(a["high"], begin)
                out["n"] = np.minimum(np.add.reduceat(a["n"].astype(np.int64), begin), MOST)
            return out

        def send(a: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = (a["hash"] % np.uint64(shards)).astype(np.int64)
            a = a[np.argsort(shard, kind="stable")]
            bounds = np.searchsorted(np.sort(shard), np.arange(shards + 1))
            for b in range(shards):
                part = a[bounds[b]:bounds[b + 1]]
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([part[c].tobytes()], pa.binary()) for c in ("hash", "p", "low", "high", "n")]],
                                                     ["b", "hash", "p", "low", "high", "n"])

        for batch in slices(batches, "t", 1_000_000):
            w = words(batch.column("t"), SPACED, False)
            found = passages(w, w.hashes(), window, gram)
            part = np.zeros(len(found.hash), kind)
            part["hash"], part["p"] = found.hash, batch.column("p").to_numpy()[found.doc]
            part["low"] = part["high"] = batch.column("id").to_numpy()[found.doc]
            part["n"] = 1
            held.append(part)
            size += len(part)
            if size > TASK_HASHES:
                held = [merged()]
                size = len(held[0])
                if size > TASK_HASHES // 2:
                    yield from send(held[0])
                    held, size = [], 0
        if held:
            yield from send(merged())

    return rows.mapInArrow(run, "b int, hash binary, p binary, low binary, high binary, n binary")


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _by_group(p: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns, cut by the values of p."""
    if not len(p):
        return
    order = np.argsort(p, kind="stable")
    p = p[order]
    begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    for i, j in zip(begin, [*begin[1:], len(p)], strict=True):
        yield (int(p[i]), *[c[order[i:j]] for c in columns])


def _shared(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a shard's minimizers those with two ids, for each group of documents that has them; `hot`: those that occur so often."""
        h, p = _column(table, "hash", np.uint64), _column(table, "p", np.int32)
        low, high = _column(table, "low", np.int64), _column(table, "high", np.int64)
        value, at = np.unique(h, return_inverse=True)
        least, most = np.full(len(value), LAST), np.full(len(value), -LAST - 1)
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, high)
        keep = (least < most)[at]
        often = (np.bincount(at, _column(table, "n", np.uint16)) > hot)[at[keep]]
        rows = [(k, hashes[~own].tobytes(), hashes[own].tobytes()) for k, hashes, own in _by_group(p[keep], h[keep], often)]
        return pa.table({"p": pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in ((1, "hash"), (2, "hot"))}})

    return run


# ---- step 2: passages of a group of documents


def _known(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values that are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(0, np.int64)
    return np.flatnonzero(sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values)


def _spread(w: Words, value: np.ndarray, found: Passages, which: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Each window of these passages by itself."""
    n = found.end[which] - found.begin[which] - window + 1
    start = np.repeat(found.begin[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out = np.zeros(len(start), WINDOWS)
    if len(start):
        out["key"] = window_hashes(value, window)[start]
        out["check"] = window_hashes(w.hashes(CHECK_SEED), window)[start]
        out["low"] = out["high"] = ids[np.repeat(found.doc[which], n)]
    return out


def _sorted_windows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows ordered by their words, and where each distinct one begins."""
    a = a[np.lexsort((a["check"], a["key"]))]
    return a, np.flatnonzero(np.r_[True, (a["key"][1:] != a["key"][:-1]) | (a["check"][1:] != a["check"][:-1])][:len(a)])


def _merged_windows(parts: list[np.ndarray]) -> np.ndarray:
    a, begin = _sorted_windows(np.concatenate(parts))
    out = a[begin]
    if len(a):
        out["low"], out["high"] = np.minimum.reduceat(a["low"], begin), np.maximum.reduceat(a["high"], begin)
    return out


def _send_passages(shards: int, window: int, gram: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        hashes, hot = (np.unique(_column(shared, c, np.uint64)) if shared.num_rows else np.zeros(0, np.uint64) for c in ("hash", "hot"))
        windows, new = [np.zeros(0, WINDOWS)], 0
        group = docs.column("p")[0].as_py() if docs.num_rows else 0
        by_shard: dict[int, dict[bytes, list[int]]] = {}
        for batch in slices(iter(docs.select(["id", "t"]).combine_chunks().to_batches()), "t") if (len(hashes) or len(hot)) and docs.num_rows else ():
            w = words(batch.column("t"), SPACED, False)
            value = w.hashes()
            found = passages(w, value, window, gram)
            keep = _known(hashes, found.hash)
            ids = batch.column("id").to_numpy()
            windows.append(_spread(w, value, found, _known(hot, found.hash), ids, window))
            new += len(windows[-1])
            if new > TASK_HASHES:
                windows, new = [_merged_windows(windows)], 0
            raw = w.bytes.tobytes()
            begin, end = w.start[found.begin[keep]].tolist(), w.end[found.end[keep] - 1].tolist()
            shard, doc = (found.hash[keep] % np.uint64(shards)).tolist(), ids[found.doc[keep]].tolist()
            for b, i, j, d in zip(shard, begin, end, doc, strict=True):
                # Only the words count, not what stands between them.
                own = by_shard.setdefault(b, {})
                text = b" ".join(raw[i:j].split())
                had = own.get(text)
                if had is None:
                    own[text] = [d, d]
                elif d < had[0]:
                    had[0] = d
                elif d > had[1]:
                    had[1] = d
        every = _merged_windows(windows)
        rows = [(b, group, b"\n".join(own), np.array([v[0] for v in own.values()], np.int64).tobytes(), np.array([v[1] for v in own.values()], np.int64).tobytes(), b"")
                for b, own in sorted(by_shard.items())]
        rows += [(b, group, b"", b"", b"", part.tobytes()) for b, part in _by_group((every["key"] % np.uint64(shards)).astype(np.int32), every)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["b", "p", "texts", "low", "high", "windows"])

    return run


# ---- step 3: automata


class SuffixAutomaton:
    """Of several sequences of words, each with an id; states know the least id whose sequence holds them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def _state(self, length: int, least: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        """Split off the part of q that is reached over p."""
        new = self._state(self.length[p] + 1, self.least[q])
        self.next[new] = dict(self.next[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int], id_: int) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                if id_ < self.least[last]:
                    self.least[last] = id_
                continue
            new = self._state(self.length[last] + 1, id_)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = new

    def finish(self) -> None:
        """Hand the least ids down the suffix links: a shorter string ends wherever a longer one does."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.least[s] < self.least[self.link[s]]:
                self.least[self.link[s]] = self.least[s]

    def first_holders(self, sequence: list[int], window: int) -> list[int]:
        """Matching statistics at the threshold: for each window the least id that holds it (LAST: none)."""
        out, state, match = [], 0, 0
        nexts, links, lengths = self.next, self.link, self.length
        for i, word in enumerate(sequence):
            while state and word not in nexts[state]:
                state = links[state]
                match = lengths[state]
            if word in nexts[state]:
                state = nexts[state][word]
                match += 1
            if i >= window - 1:
                if match < window:
                    out.append(LAST)
                else:
                    while lengths[links[state]] >= window:
                        state = links[state]
                        match = lengths[state]
                    out.append(self.least[state])
        return out


def _answer(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        """Per group of documents: hash of a passage, and the runs of its windows whose first holder is below the passage's largest id."""
        texts = [t.split(b"\n") if t else [] for t in table.column("texts").to_pylist()]
        group = np.repeat(np.array(table.column("p").to_pylist(), np.int32), [len(t) for t in texts])
        every = [t for part in texts for t in part]
        low, high = _column(table, "low", np.int64), _column(table, "high", np.int64)
        distinct: dict[bytes, int] = {}
        at = np.array([distinct.setdefault(t, len(distinct)) for t in every], np.int64)
        least, most = np.full(len(distinct), LAST), np.full(len(distinct), -LAST - 1)
        np.minimum.at(least, at, low)
        np.maximum.at(most, at, high)
        listed = list(distinct)
        w = words(_as_strings(listed), SPACED, False)
        value = w.hashes()
        key = passage_hashes(value, w.first[:-1], w.first[1:])
        # Passages that can share a window share their minimizer, so a shard is cut between minimizers.
        grams = window_hashes(value, gram)
        mini = np.array([grams[i:j - gram + 1].min() if j - i >= gram else 0 for i, j in zip(w.first, w.first[1:], strict=False)], np.uint64)
        mini = _common(w, grams, window, gram, mini)
        order = np.argsort(mini, kind="stable")
        symbol = w.codes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in listed]
        begin = 0
        while begin < len(order):
            stop, size = begin, 0
            while stop < len(order) and (size < SHARD_WORDS or mini[order[stop]] == mini[order[stop - 1]]):
                size += int(w.first[order[stop] + 1] - w.first[order[stop]])
                stop += 1
            automaton = SuffixAutomaton()
            shard = order[begin:stop].tolist()
            sequences = [symbol[w.first[i]:w.first[i + 1]].tolist() for i in shard]
            for i, s in zip(shard, sequences, strict=True):
                automaton.add(s, int(least[i]))
            automaton.finish()
            for i, s in zip(shard, sequences, strict=True):
                holders = automaton.first_holders(s, window)
                run_, top = found[i], int(most[i])
                for k, holder in enumerate(holders):
                    if holder < top:
                        if run_ and run_[-1][1] == k and run_[-1][2] == holder:
                            run_[-1] = (run_[-1][0], k + 1, holder)
                        else:
                            run_.append((k, k + 1, holder))
            begin = stop
        many = np.array([len(f) for f in found], np.int64)
        flat = np.zeros(int(many.sum()), RUNS)
        if len(flat):
            flat["key"] = np.repeat(key, many)
            runs = np.array([x for f in found for x in f], np.int64)
            flat["from"], flat["to"], flat["holder"] = runs[:, 0], runs[:, 1], runs[:, 2]
        start = np.concatenate([[0], np.cumsum(many)])
        rows = []
        for p, own, top in _by_group(group, at, high):
            n = many[own]
            pick = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            part = flat[pick]
            part = part[part["holder"] < np.repeat(top, n)]
            if len(part):
                rows.append((p, part.tobytes()))
        rows += _answer_windows(table)
        return pa.table({"p": pa.array([r[0] for r in rows], pa.int32()), "runs": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answer_windows(table: pa.Table) -> list[tuple[int, bytes]]:
    """Of the windows of hot minimizers, as runs of one window: for each group whose largest id is above the first holder."""
    sent = table.column("windows").to_pylist()
    group = np.repeat(np.array(table.column("p").to_pylist(), np.int32), [len(x) // WINDOWS.itemsize for x in sent])
    a = np.frombuffer(b"".join(sent), WINDOWS)
    order = np.lexsort((a["check"], a["key"]))
    group = group[order]
    a, begin = _sorted_windows(a)
    if not len(a):
        return []
    least = np.repeat(np.minimum.reduceat(a["low"], begin), np.diff(np.r_[begin, len(a)]))
    told = np.flatnonzero(least < a["high"])
    out = np.zeros(len(told), RUNS)
    out["key"], out["holder"], out["to"] = a["key"][told], least[told], 1
    return [(p, part.tobytes()) for p, part in _by_group(group[told], out)]


def _as_strings(listed: list[bytes]) -> pa.Array:
    """A string array of these bytes, valid UTF-8 or not."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(listed), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(listed))])


def _common(w: Words, grams: np.ndarray, window: int, gram: int, fallback: np.ndarray) -> np.ndarray:
    """The minimizer of each passage: all its windows have the same, so the first window's."""
    out = fallback.copy()
    whole = np.flatnonzero(w.counts >= window)
    if len(whole):
        view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
        out[whole] = view[w.first[:-1][whole]].min(1)
    return out


def passage_hashes(word_hash: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words: the sum of what each word and its place give."""
    n = end - begin
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    each = mix(word_hash[np.repeat(begin, n) + place] ^ mix(place.astype(np.uint64) + np.uint64(CHECK_SEED)))
    # A range without words has no element of its own to sum.
    some = n > 0
    out = n.astype(np.uint64)
    if some.any():
        out[some] += np.add.reduceat(each, first[some])
    return mix(out)


# ---- step 4: spans of a document


def removed(w: Words, ids: np.ndarray, runs: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which words of a batch go, given its group's runs sorted by key."""
    out = np.zeros(len(w) + 1, np.int64)
    if not len(runs) or not len(w):
        return out[:-1] > 0
    value = w.hashes()
    found = passages(w, value, window, gram)
    key = passage_hashes(value, found.begin, found.end)
    lo, hi = np.searchsorted(runs["key"], key), np.searchsorted(runs["key"], key, side="right")
    n = hi - lo
    pick = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    which = np.repeat(np.arange(len(key)), n)
    part = runs[pick]
    mine = part["holder"] < ids[found.doc[which]]
    part, which = part[mine], which[mine]
    np.add.at(out, found.begin[which] + part["from"], 1)
    # Windows from..to - 1 cover the words up to to - 1 + window.
    np.add.at(out, found.begin[which] + part["to"].astype(np.int64) - 1 + window, -1)
    # What is told of one window holds wherever its words stand.
    single = runs[(runs["from"] == 0) & (runs["to"] == 1)]
    start = within(w, window) if len(single) else np.zeros(0, np.int64)
    if len(start):
        key = window_hashes(value, window)[start]
        at = np.minimum(np.searchsorted(single["key"], key), len(single) - 1)
        doc = np.searchsorted(w.first, start, side="right") - 1
        start = start[(single["key"][at] == key) & (single["holder"][at] < ids[doc])]
        np.add.at(out, start, 1)
        np.add.at(out, start + window, -1)
    return np.cumsum(out[:-1]) > 0


def _routed(rows: DataFrame, grouped: DataFrame, shards: int, window: int, gram: int, hot: int | None) -> DataFrame:
    """What each group of documents sends to each shard; rows: p, id, t."""
    hot = min(MOST - 1, SHARD_WORDS // (2 * window - gram) if hot is None else hot)
    shared = _minimizers(rows.select("p", "id", "t"), shards, window, gram).groupBy("b").applyInArrow(_shared(hot), "p int, hash binary, hot binary")
    return grouped.groupBy("p").cogroup(shared.groupBy("p")).applyInArrow(_send_passages(shards, window, gram), "b int, p int, texts binary, low binary, high binary, windows binary")


def dedup(docs: DataFrame, finish, schema: str, carry: list[str], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
          hot: int | None = None) -> DataFrame:
    """Find what goes from each document, and give what `finish(batch, words, removed)` makes of it.

    batch: the columns `carry`, then id and t; finish returns a RecordBatch of `schema`.
    hot: minimizers that occur more often go window by window; by default if their passages may exceed SHARD_WORDS.
    """
    gram = min(gram, window)
    spark = docs.sparkSession
    size = total_bytes(docs, text)
    groups = partitions_for(spark, size, GROUP_BYTES)
    own = [quoted(c) for c in carry]
    content = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    key = F.pmod(F.xxhash64(F.col(quoted(doc_id)).cast("long"), content), F.lit(groups)).cast("int")
    rows = docs.select(key.alias("p"), F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(LAST)).alias("id"), content.alias("t"), F.struct(*own).alias("carry") if own else F.lit(None).alias("carry"))
    grouped = rows.repartition(groups, "p")
    runs = _routed(rows, grouped, groups, window, gram, hot).groupBy("b").applyInArrow(_answer(window, gram), "p int, runs binary")

    def last(table: pa.Table, answer: pa.Table) -> pa.Table:
        found = np.sort(_column(answer, "runs", RUNS), order="key") if answer.num_rows else np.zeros(0, RUNS)
        made = []
        if table.num_rows:
            for batch in slices(iter(table.combine_chunks().to_batches()), "t"):
                w = words(batch.column("t"), SPACED, False)
                made.append(finish(batch, w, removed(w, batch.column("id").to_numpy(), found, window, gram)))
        return pa.Table.from_batches(made).cast(empty.schema) if made else empty

    empty = to_arrow_schema(struct(schema)).empty_table()
    return grouped.groupBy("p").cogroup(runs.groupBy("p")).applyInArrow(last, schema)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def finish(batch: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        import hashlib

        raw = w.bytes.tobytes()
        bounds = w.first.tolist()
        start, end = w.start.tolist(), w.end.tolist()
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = (total[w.first[1:]] - total[w.first[:-1]])
        sums = []
        for d, n in enumerate(lost.tolist()):
            i, j = bounds[d], bounds[d + 1]
            parts = raw[start[i]:end[j - 1]].split() if j > i else []
            if n:
                parts = [x for x, g in zip(parts, gone[i:j].tolist(), strict=True) if not g]
            sums.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        ids = batch.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == LAST), pa.array(w.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(sums)],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return dedup(docs, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", [], **options)


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, out: str = "removed_words") -> DataFrame:
    """The documents with the removed words cut out of the text, each with the space before the next word; all columns are kept.

    `out` is appended: how many words went (a column of that name is replaced). A null text stays null.
    """
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    others = [c for c in columns if c != text]

    def finish(batch: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        raw = w.bytes.tobytes()
        total = np.concatenate([[0], np.cumsum(gone)])
        lost = total[w.first[1:]] - total[w.first[:-1]]
        offsets = string_bytes(batch.column("t"))[1].tolist()
        texts = batch.column("t").to_pylist()
        for d in np.flatnonzero(lost).tolist():
            i, j = int(w.first[d]), int(w.first[d + 1])
            parts, at = [], offsets[d]
            for k in range(i, j):
                if gone[k]:
                    parts.append(raw[at:int(w.start[k])])
                    at = int(w.start[k + 1]) if k + 1 < j else offsets[d + 1]
            texts[d] = b"".join([*parts, raw[at:offsets[d + 1]]]).decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([batch.column("carry"), pa.array(texts, pa.string()), pa.array(lost.astype(np.int64))], ["carry", "t", "lost"])

    # A text travels once; whether it was null is all that is carried of it.
    carried = docs.select(*[quoted(c) for c in others], F.col(quoted(text)).isNull().alias("__null"), F.col(quoted(doc_id)).alias("__doc_id"), F.col(quoted(text)).alias("__content"))
    carry = [*others, "__null"]
    inner = carried.select(F.struct(*[quoted(c) for c in carry]).alias("carry")).schema["carry"].dataType.simpleString()
    found = dedup(carried, finish, f"carry {inner}, t string, lost bigint", carry, doc_id="__doc_id", text="__content", window=window, gram=gram)
    whole = F.when(~F.col("carry")["__null"], F.col("t"))
    return found.select(*[whole.alias(c) if c == text else F.col("carry")[c].alias(c) for c in columns], F.col("lost").alias(out))


#: The contract as DuckDB SQL, for tables of a few million words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(ws) - 11)) t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM windows JOIN firsts USING (s), range(13) r(j) WHERE first < doc_id),
listed AS (SELECT doc_id, k, ws[k] AS word FROM d, unnest(range(1, len(ws) + 1)) t(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM listed ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""
