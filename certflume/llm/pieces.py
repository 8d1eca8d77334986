"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best path through a text's lattice of pieces is a product of transfer
matrices over (max, +): entry (a, b) of a chunk's matrix is the best score of
the pieces between boundary state a at its left end and b at its right end,
where a state is the piece that covers the last character before the boundary.
Products are associative, so a giant document is cut into chunks that are
worked on in different tasks, their matrices are combined in groups, the groups
in turn, and with its two boundary states known each chunk finds its own pieces.

A unigram model scores a path by the sum of its pieces' scores. A BPE model is
the same scan with scores 0 and minus infinity: a sequence of pieces is what the
merges give exactly if every two neighbours, merged alone, stay as they are.

No piece crosses a cut (before a run of spaces, around a character in no piece),
so there a matrix has one state. A usual document is a sequence of such units,
and the path of a unit is remembered.

Nulls: a null text has null ids, an empty one none. `decode` of null is null.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .frames import extend, partitions_for, quoted, releasing, saved, small_batches, struct, total_bytes, without
from .text import CHECK_SEED, SEED, mix, range_hashes

SPACE = "▁"
#: Characters in a chunk; longer documents are scanned in parallel.
CHUNK_CHARS = 1 << 15
#: Bytes of giant documents in a task.
TASK_BYTES = 512 << 10
#: Matrices in one step of the scan.
GROUP = 64
#: Units and pairs that a task remembers before it starts afresh.
UNITS, PAIRS = 600_000, 1_000_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 500_000
#: Characters of units that are worked on together; longer ones go one by one.
LONG_UNIT = 64
NEVER = float("-inf")


#: Nothing remembered yet: sorted unit hashes, a second hash of each, where its ids begin and how many they are, and all ids as they came.
#: The one entry stands for no unit.
EMPTY = np.array([(1 << 64) - 1], np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(0, np.int32)


class Model:
    """Pieces, scores and kind of a SentencePiece model, with the lattice's rules."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool):
        self.listed = pieces
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.texts = [p for p, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        self.longest = max((len(p) for p, _, kind in pieces if kind in (1, 4)), default=1)
        self._walk: tuple[np.ndarray, np.ndarray] | None = None
        self._remembered = EMPTY
        self._seed = SEED
        self._spelled: tuple[np.ndarray, np.ndarray] | None = None
        self._known = np.array([-1], np.int64), np.array([False])
        self._follows: dict[int, bool] = {}
        self._pairs: dict = {}
        self._units: dict = {}

    # Only encoding needs these.

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, kind) in enumerate(self.listed) if kind in (1, 4)}

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: s for p, s, kind in self.listed if kind in (1, 4)}

    @cached_property
    def prefixes(self) -> set[str]:
        return {p[:k] for p in self.ids for k in range(1, len(p) + 1)}

    @cached_property
    def letters(self) -> set[str]:
        return set().union(*self.ids)

    @cached_property
    def least(self) -> float:
        return min(self.scores.values(), default=0.0) - 10

    @cached_property
    def inner_space(self) -> bool:
        return any(SPACE in p.lstrip(SPACE) for p in self.ids)

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are read")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type == 2, norm.add_dummy_prefix)

    # ---- the lattice

    def escaped(self, text: str) -> str:
        return ((" " if self.dummy_prefix and text else "") + text).replace(" ", SPACE)

    def cut(self, text: str, i: int) -> bool:
        """No piece of the lattice crosses this place."""
        if i <= 0 or i >= len(text):
            return True
        before, after = text[i - 1], text[i]
        return (after == SPACE and before != SPACE and not self.inner_space) or before not in self.letters or after not in self.letters

    def starting(self, text: str, i: int) -> Iterator[str]:
        """The pieces that may start here; a character that is no piece stands for itself."""
        if text[i] not in self.ids:
            yield text[i]
        for end in range(i + 1, min(len(text), i + self.longest) + 1):
            piece = text[i:end]
            if piece not in self.prefixes:
                return
            if piece in self.ids:
                yield piece

    def merge(self, text: str) -> list[str]:
        """The merges of a short text: best score first, then leftmost."""
        parts, score = list(text), self.scores.get
        found = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best = max(found)
            if best == NEVER:
                break
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(found):
                found[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def link(self, before: str, piece: str) -> float:
        """The score of `piece` after `before` (empty: after a cut)."""
        if not self.bpe:
            return self.scores.get(piece, self.least)
        if not before:
            key = piece
        else:
            key = (before, piece)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            merged = self.merge(before + piece)
            known = self._pairs[key] = 0.0 if merged == ([before, piece] if before else [piece]) else NEVER
        return known

    # ---- units

    def unit(self, text: str) -> list[int]:
        """Ids of the best path of a text between two cuts."""
        known = self._units.get(text)
        if known is None:
            if len(self._units) > UNITS:
                self._units.clear()
            known = self.ids_of(self.path(text, 0, len(text), (0, ""), None))
            self._units[text] = known
        return known

    def between_cuts(self, word: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(word)) if self.cut(word, i)), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all beginnings of pieces, and the piece that each is (-1: none)."""
        if self._walk is None:
            listed = sorted(self.prefixes)
            chars, begin, length = code_points(listed), *_bounds([len(x) for x in listed])
            key = np.zeros(len(listed), np.uint64)
            for n in range(self.longest):
                more = np.flatnonzero(length - begin > n)
                key[more] = grown(key[more], chars[begin[more] + n])
            order = np.argsort(key)
            self._walk = key[order], np.array([self.ids.get(listed[i], -1) for i in order], np.int64)
            # Of each code point: 2 if it is a piece, 1 if it is in one, else 0.
            self._kind = np.zeros(0x110000, np.uint8)
            self._kind[[ord(c) for c in self.letters]] = 1
            self._kind[[ord(p) for p in self.ids if len(p) == 1]] = 2
        return self._walk

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of escaped texts one after the other, and where each text's begin. Each distinct unit is worked on once."""
        self._tables()
        chars = code_points(texts)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.r_[0, np.cumsum(length)]
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = self._kind[chars]
        cut = np.zeros(len(chars) + 1, bool)
        cut[first] = True
        if not self.inner_space:
            space = chars == ord(SPACE)
            cut[1:-1] |= space[1:] & ~space[:-1]
        cut[1:-1] |= (kind[1:] == 0) | (kind[:-1] == 0)
        bounds = np.flatnonzero(cut)
        begin, end = bounds[:-1], bounds[1:]
        # Two hashes stand for a unit; if one alone is equal, both are made anew with another seed.
        data = chars.view(np.uint8)
        hashed, check = range_hashes(data, 4 * begin, 4 * end, self._seed), range_hashes(data, 4 * begin, 4 * end, self._seed ^ CHECK_SEED)
        key, one, back = np.unique(hashed, return_index=True, return_inverse=True)
        known = self._remembered[0]
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        had = known[place] == key
        if (check != check[one][back]).any() or (self._remembered[1][place[had]] != check[one][had]).any():
            self._remembered, self._seed = EMPTY, int(mix(np.array([self._seed], np.uint64))[0])
            return self.encode_all(texts)
        new = np.flatnonzero(~had)
        if len(new):
            if len(known) + len(new) > UNITS:
                # Start afresh with what this batch needs.
                self._remembered = EMPTY
                new = np.arange(len(key))
            return self.encode_all_known(key, check[one], one, back, begin, end, first, chars, kind, new)
        return self._gathered(place, back, begin, first)

    def encode_all_known(self, key, check, one, back, begin, end, first, chars, kind, new):
        """Learn the new units, then look all up."""
        b, e = begin[one[new]], end[one[new]]
        plain = np.add.reduceat((kind != 2).astype(np.int64), begin)[one[new]] == 0
        plain &= (e - b <= LONG_UNIT) & self.bpe
        parts: list = [None] * len(new)
        quick = np.flatnonzero(plain)
        if len(quick):
            ids, offsets = self.paths(b[quick], e[quick], chars)
            for n, i in enumerate(quick.tolist()):
                parts[i] = ids[offsets[n]:offsets[n + 1]]
        for i in np.flatnonzero(~plain).tolist():
            text = chars[b[i]:e[i]].tobytes().decode("utf-32-le", "surrogatepass")
            parts[i] = np.array(self.unit(text), np.int32)
        known, checks, starts, sizes, flat = self._remembered
        length = np.array([len(x) for x in parts], np.int32)
        # The ids stay in the order in which they were learned: only what finds them is sorted.
        starts = np.concatenate([starts, len(flat) + np.cumsum(length, dtype=np.int64) - length])
        flat = np.concatenate([flat, *parts], dtype=np.int32, casting="same_kind")
        del parts
        known = np.concatenate([known, key[new]])
        order = np.argsort(known, kind="stable")
        self._remembered = known[order], np.concatenate([checks, check[new]])[order], starts[order], np.concatenate([sizes, length])[order], flat
        return self._gathered(np.searchsorted(self._remembered[0], key), back, begin, first)

    def _gathered(self, place: np.ndarray, back: np.ndarray, begin: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, starts, sizes, flat = self._remembered
        start, size = starts[place][back], sizes[place][back]
        total = np.r_[0, np.cumsum(size, dtype=np.int64)]
        return flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total[np.searchsorted(begin, first)]

    def paths(self, unit_begin: np.ndarray, unit_end: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of BPE units of whole pieces, ranges of characters. Only one sequence of pieces is valid for each prefix of a
        unit, so each end needs one node, and all units take the step from a place at the same time."""
        keys, values = self._tables()
        length = unit_end - unit_begin
        first = np.cumsum(length) - length
        # The pieces that may start at each character: grown letter by letter as long as any piece begins so.
        at = np.arange(int(length.sum()))
        word = np.repeat(np.arange(len(length)), length)
        shift = (unit_begin - first)[word]
        stop = (first + length)[word]
        begins, ends, names = [], [], []
        h = np.zeros(len(at), np.uint64)
        for n in range(1, self.longest + 1):
            inside = at + n <= stop[at]
            at = at[inside]
            h = grown(h[inside], chars[at + shift[at] + n - 1])
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[place] == h
            at, piece, h = at[known], values[place[known]], h[known]
            whole = piece >= 0
            begins.append(at[whole])
            ends.append(at[whole] + n)
            names.append(piece[whole])
        begin, end, name = (np.concatenate(x) for x in (begins, ends, names))
        # A node stands at the last character of its piece.
        last = np.full(len(word), -1, np.int64)
        origin = np.zeros(len(word), np.int64)
        step = begin - first[word[begin]]
        order = np.argsort(step, kind="stable")
        begin, end, name, step = begin[order], end[order], name[order], step[order]
        bounds = np.searchsorted(step, np.arange(int(length.max(initial=0)) + 1))
        for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            s, e, piece = begin[a:b], end[a:b], name[a:b]
            before = last[s - 1] if p else np.full(b - a, -1)
            open_ = (last[e - 1] < 0) & ((before >= 0) | (p == 0))
            s, e, piece, before = s[open_], e[open_], piece[open_], before[open_]
            valid = self.follow(before, piece)
            last[e[valid] - 1], origin[e[valid] - 1] = piece[valid], s[valid]
        # Back from the ends: all units take a piece at a time.
        live, here = np.arange(len(length)), first + length
        who, what = [], []
        while len(live):
            who.append(live)
            what.append(last[here - 1])
            here = origin[here - 1]
            more = here > first[live]
            live, here = live[more], here[more]
        unit, ids = np.concatenate(who[::-1]), np.concatenate(what[::-1])
        order = np.argsort(unit, kind="stable")
        return ids[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(unit, minlength=len(length)))]

    def follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pieces are valid after these (-1: after a cut)."""
        key = (before + 1 << 32) | piece
        keys, values = self._known
        out = np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        out[hit] = values[place[hit]]
        rest, back = np.unique(key[~hit], return_inverse=True)
        if len(rest):
            fresh = np.zeros(len(rest), bool)
            for n, k in enumerate(rest.tolist()):
                known = self._follows.get(k)
                if known is None:
                    a, b = (self.texts[(k >> 32) - 1] if k >> 32 else ""), self.texts[k & 0xFFFFFFFF]
                    known = self._follows[k] = self.merge(a + b) == ([a, b] if a else [b])
                fresh[n] = known
            out[~hit] = fresh[back]
        if len(self._follows) > 0.1 * len(keys) + 1000:
            # What was learned joins the sorted pairs.
            if len(keys) > PAIRS:
                keys, values = keys[:0], values[:0]
            more = np.fromiter(self._follows, np.int64, len(self._follows))
            keys, values = np.concatenate([keys, more]), np.concatenate([values, np.fromiter(self._follows.values(), bool, len(more))])
            order = np.argsort(keys)
            self._known = keys[order], values[order]
            self._follows = {}
        return out

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, escaped: str) -> list[int]:
        """Ids of a text that starts and ends at a cut."""
        return self.encode_all([escaped])[0].tolist()

    # ---- chunks

    def reach(self, text: str, begin: int, hi: int, entry: tuple[int, str]) -> dict:
        """Best scores of the nodes (start, piece) on paths from `entry`, by end; with the node before."""
        nodes: dict[int, dict] = {entry[0] + len(entry[1]): {entry: (0.0, None)}}
        for p in range(begin, hi):
            here = nodes.get(p)
            if not here:
                continue
            fresh = self.cut(text, p) if p else True
            for piece in self.starting(text, p):
                best, back = NEVER, None
                for node, (score, _) in here.items():
                    got = score + self.link("" if fresh else node[1], piece)
                    if got > best:
                        best, back = got, node
                if best > NEVER:
                    nodes.setdefault(p + len(piece), {})[(p, piece)] = (best, back)
        return nodes

    def path(self, text: str, lo: int, hi: int, entry: tuple[int, str], leave: tuple[int, str] | None) -> list[str]:
        """Pieces from `entry` on that start before `hi`; the last is `leave`, or ends at `hi`."""
        nodes = self.reach(text, entry[0] + len(entry[1]), hi, entry)
        if leave is None:
            if hi not in nodes or not nodes[hi]:
                raise ValueError("no path")
            leave = max(nodes[hi], key=lambda n: (nodes[hi][n][0], n[0]))
        out = []
        node = leave
        while node != entry:
            out.append(node[1])
            node = nodes[node[0] + len(node[1])][node][1]
        return out[::-1]

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """The pieces that may cover the character before `at`: (start, piece)."""
        if not at:
            return [(0, "")]
        return [(s, p) for s in range(max(0, at - self.longest), at) for p in self.starting(text, s)
                if s + len(p) >= at and not any(self.cut(text, i) for i in range(s + 1, s + len(p)))]

    def cuts(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last place in [lo + longest, hi - longest] that no piece crosses."""
        first = next((i for i in range(lo + self.longest, hi - self.longest + 1) if self.cut(text, i)), None)
        if first is None:
            return None
        return first, next(i for i in range(hi - self.longest, first - 1, -1) if self.cut(text, i))

    def transfer(self, text: str, lo: int, hi: int) -> dict:
        """The chunk's matrix: {(state at lo, state at hi): score}, states as (start - boundary, piece)."""
        out = {}
        between = self.cuts(text, lo, hi)
        if between:
            first, last = between
            nodes = self.reach(text, last, hi, (last, ""))
            tail = {n: v[0] for at in nodes if at >= hi for n, v in nodes[at].items()}
        for entry in self.states(text, lo):
            stop = between[0] if between else hi
            nodes = self.reach(text, entry[0] + len(entry[1]), stop, entry)
            if between:
                # The middle is the same for all paths; in a unigram model its score is one number that changes no choice.
                head = max((v[0] for v in nodes.get(stop, {}).values()), default=NEVER)
                ends = {n: head + v for n, v in tail.items()}
            else:
                ends = {n: v[0] for at in nodes if at >= hi for n, v in nodes[at].items()}
            for (s, p), score in ends.items():
                if score > NEVER:
                    out[(entry[0] - lo, entry[1]), (s - hi, p)] = score
        return out

    def trace(self, text: str, lo: int, hi: int, entry: tuple[int, str], leave: tuple[int, str]) -> list[int]:
        """Ids of the pieces that start in the chunk, its boundary states given."""
        entry, leave = (entry[0] + lo, entry[1]), (leave[0] + hi, leave[1])
        between = self.cuts(text, lo, hi)
        if not between:
            return self.ids_of(self.path(text, lo, hi, entry, leave))
        first, last = between
        return (self.ids_of(self.path(text, lo, first, entry, None)) + self.encode(text[first:last])
                + self.ids_of(self.path(text, last, hi, (last, ""), leave)))

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts: bytes joined where they stand, special pieces left out, the dummy space taken off."""
        if self._spelled is None:
            spelled = [bytes([int(t[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" if k == 3 else t.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                       for t, k in zip(self.texts, self.kinds, strict=True)]
            self._spelled = np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(x) for x in spelled])]
        data, at = self._spelled
        size = at[ids + 1] - at[ids]
        total = np.r_[0, np.cumsum(size)]
        raw = data[np.repeat(at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        out = []
        for b, e in zip(total[first[:-1]].tolist(), total[first[1:]].tolist(), strict=True):
            skip = self.dummy_prefix and raw[b:b + 1] == b" " and e > b
            out.append(raw[b + skip:e].decode("utf-8", "replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bounds(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum(np.array(lengths, np.int64))
    return end - lengths, end


def grown(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The hash of a string from that of the string without its last character."""
    return mix(h * np.uint64(SEED) + char.astype(np.uint64) + np.uint64(1))


def product(left: dict, right: dict) -> dict:
    """The (max, +) product of two matrices."""
    rows: dict = {}
    for (b, c), score in right.items():
        rows.setdefault(b, []).append((c, score))
    out: dict = {}
    for (a, b), score in left.items():
        for c, more in rows.get(b, ()):
            if score + more > out.get((a, c), NEVER):
                out[a, c] = score + more
    return out


def boundary_states(matrices: list[dict], entry, leave) -> list:
    """States at the inner boundaries of the best path from `entry` to `leave` (None: the best there is)."""
    best: list[dict] = [{entry: (0.0, None)}]
    for m in matrices:
        step: dict = {}
        for (a, b), score in m.items():
            if a in best[-1] and best[-1][a][0] + score > step.get(b, (NEVER, None))[0]:
                step[b] = best[-1][a][0] + score, a
        best.append(step)
    state = leave if leave is not None else max(best[-1], key=lambda s: best[-1][s][0])
    states = [state]
    for step in reversed(best[1:]):
        state = step[state][1]
        states.append(state)
    return states[::-1]


# ---- Spark


def _send(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(pickle.dumps((model.listed, model.bpe, model.dummy_prefix)))


def _received(sent) -> Model:
    """The model of a worker process: with what it remembers it outlives the task, as functions that travel do not."""
    held = sys.__dict__.setdefault("_certflume_pieces", {})
    key = hash(sent.value)
    if key not in held:
        held.clear()
        # What earlier steps left in this process is not needed beside a model.
        sys.__dict__.get("_certflume_shipped", {}).clear()
        held[key] = Model(*pickle.loads(sent.value))
    return held[key]


def encode(docs: DataFrame, model: Model, text: str = "text", out: str = "ids", chunk: int = CHUNK_CHARS, keep: list[str] | None = None,
           verify: str | None = None) -> DataFrame:
    """Append the ids of each text, array<int>. A column of that name is replaced.

    `verify` names a further column: whether the ids, decoded, give the text again (with
    ▁ read as the space that it stands for; null for a null text). Decoding then takes place
    in the step that encodes, not in a second Python process.
    """
    sent = _send(docs, model)
    chunk = max(chunk, 4 * model.longest)
    own = docs if keep is None else docs.select(*[quoted(c) for c in keep if c.lower() != text.lower()], quoted(text))
    own = without(own, [out, *([verify] if verify else [])])
    long = F.length(F.col(quoted(text)).cast("string")) > chunk

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m = _received(sent)
        column = batch.column("__text")
        texts = column.to_pylist()
        ids, first = m.encode_all([m.escaped(t or "") for t in texts])
        offsets = pa.array(first.astype(np.int32), mask=np.r_[column.is_null().to_numpy(zero_copy_only=False), False]) if column.null_count else pa.array(first.astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
        if verify:
            back = m.decode_all(ids, first)
            made.append(pa.array([None if t is None else t.replace(SPACE, " ") == b for t, b in zip(texts, back, strict=True)], pa.bool_()))
        return made

    columns = [c for c in own.columns if keep is None or c in keep]
    short = extend(own.where(~F.coalesce(long, F.lit(False))), text, make, struct(f"{quoted(out)} array<int>" + (f", {quoted(verify)} boolean" if verify else "")), size=BATCH_BYTES, keep=columns)
    giants = _giants(own.where(long), sent, text, out, chunk, columns, with_text=bool(verify))
    if verify:
        decoded = decode(giants, model, out, "__back")
        giants = decoded.select(*[quoted(c) for c in [*columns, out]], (F.translate("__given", SPACE, " ") == F.col("__back")).alias(verify))
    return short.unionByName(giants)


def _giants(docs: DataFrame, sent, text: str, out: str, chunk: int, columns: list[str], with_text: bool = False) -> DataFrame:
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = m.escaped(t)
                ends = list(range(chunk, len(t), chunk))
                if ends and len(t) - ends[-1] < 4 * m.longest:
                    ends.pop()
                bounds = [0, *ends, len(t)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    a, b = max(0, lo - 2 * m.longest), min(len(t), hi + 2 * m.longest)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([t[a:b]]), pa.array([lo - a], pa.int32()), pa.array([hi - a], pa.int32())],
                                                     ["row", "k", "piece", "lo", "hi"])

    chunks = rows.select("__row", F.col(quoted(text)).cast("string")).mapInArrow(releasing(split), "row bigint, k int, piece string, lo int, hi int")
    # A chunk costs far more time than its bytes tell, so the number of tasks is given, not left to their size.
    chunks = chunks.repartition(partitions_for(docs.sparkSession, total_bytes(rows, text), TASK_BYTES), "row", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for batch in batches:
            made = [pickle.dumps(m.transfer(t, lo, hi)) for t, lo, hi in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["row", "k", "m"])

    parts = chunks.mapInArrow(releasing(matrices), "row bigint, k int, m binary").withColumn("g", (F.col("k") / GROUP).cast("int"))

    def ordered(table: pa.Table) -> tuple[list, list[dict]]:
        table = table.sort_by("k") if "k" in table.column_names else table.sort_by("g")
        return table.to_pylist(), [pickle.loads(x) for x in table.column("m").to_pylist()]

    def combine(table: pa.Table) -> pa.Table:
        found, ms = ordered(table)
        total = ms[0]
        for m in ms[1:]:
            total = product(total, m)
        return pa.table({"row": [found[0]["row"]], "g": pa.array([found[0]["g"]], pa.int32()), "m": [pickle.dumps(total)]})

    def choose(table: pa.Table) -> pa.Table:
        found, ms = ordered(table)
        states = boundary_states(ms, (0, ""), None)
        pairs = [pickle.dumps(p) for p in zip(states, states[1:], strict=False)]
        return pa.table({"row": [f["row"] for f in found], "g": pa.array([f["g"] for f in found], pa.int32()), "ends": pa.array(pairs, pa.binary())})

    def refine(table: pa.Table, group: pa.Table) -> pa.Table:
        if not table.num_rows or not group.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "ends": pa.array([], pa.binary())})
        found, ms = ordered(table)
        states = boundary_states(ms, *pickle.loads(group.column("ends")[0].as_py()))
        pairs = [pickle.dumps(p) for p in zip(states, states[1:], strict=False)]
        return pa.table({"row": [f["row"] for f in found], "k": pa.array([f["k"] for f in found], pa.int32()), "ends": pa.array(pairs, pa.binary())})

    groups = parts.groupBy("row", "g").applyInArrow(combine, "row bigint, g int, m binary")
    chosen = groups.groupBy("row").applyInArrow(choose, "row bigint, g int, ends binary")
    ends = parts.groupBy("row", "g").cogroup(chosen.groupBy("row", "g")).applyInArrow(refine, "row bigint, k int, ends binary")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for batch in batches:
            made = [m.trace(t, lo, hi, *pickle.loads(e)) for t, lo, hi, e in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32()))], ["row", "k", "ids"])

    traced = chunks.join(ends, ["row", "k"]).select("row", "k", "piece", "lo", "hi", "ends").mapInArrow(releasing(traces), "row bigint, k int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("__ids"))
    both = rows.join(whole, rows["__row"] == whole["row"], "left")
    return both.select(*[quoted(c) for c in columns], F.col("__ids").alias(out), *([F.col(quoted(text)).cast("string").alias("__given")] if with_text else []))


def decode(df: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of each row's ids. A column of that name is replaced."""
    sent = _send(df, model)
    small_batches(df.sparkSession)
    own = without(df, [out])
    schema = StructType([*own.schema.fields, *struct(f"{quoted(out)} string").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = part.column(ids)
                size = lists.value_lengths().fill_null(0).to_numpy()
                texts = m.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(size)])
                made = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=names)

    return own.mapInArrow(releasing(run), schema)
