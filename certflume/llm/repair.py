"""Repair of damaged conversations by a checkpointed dynamic programme.

A conversation should be empty or `system? (user assistant)+`. Its rows, in order of
turn (nulls first), then role and text, may be kept, given another role, deleted, or joined by inserted
rows; of the cheapest ways the one whose edits read least in ASCII is taken.

The states are what the last row was (nothing, system, user, assistant). Cost vectors
of what is left to do run backward over the rows; only those at every n-th row of n * n are stored.
Walking forward, the vectors of a block are made again from the checkpoint at its end, and
the least letter whose cost is tight is emitted. Conversations of a task are worked on side by side.

A conversation of more than `limit` rows or bytes is never in one task as a whole: its
rows, equal ones counted together, are dealt out in ranges. Backward, a range is a matrix over (min, +) of
four states; the products give the checkpoints at the ranges' ends, and which state each
range leaves for each that it can be entered in gives the entries. Then all ranges walk at the same time.
Only the digest of its repaired text must read the rows one after the other.

Nulls: a null role or text, and a null id or turn in the key that decides on damage, count as one space;
rows with a null id are one conversation. Roles other than those that begin with s, u or a (an empty
one, too) cannot be kept. Rows equal in id and turn are ordered by role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import partitions_for, quoted, saved, small_batches, struct
from .text import SPACED, string_bytes

#: Costs of the edits, and of a truncated row that stays.
RETELL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of a conversation that one task works on, bytes of a range of a larger one, rows worked on side by side.
ROWS, BYTES, RANGE_BYTES, CHUNK_ROWS = 50_000, 32 << 20, 16 << 20, 4096
NEVER = 1 << 40
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or retold row.
NEXT = np.array([USER, USER, ASSISTANT, USER])
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
ROLES = ("", "system", "user", "assistant")
FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of every row, as crc32 of `id:turn` modulo 20 decides: dropped rows have 0 copies."""
    name = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv_id), F.lit(":"), name(turn))) % 20
    told = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(name(text), ".!?", "")).otherwise(name(text))
    return conversations.select(F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).cast("long").alias("turn"),
                                F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(name(role)).alias("role"), told.alias("text"),
                                F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


# ---- the programme


@dataclass
class Rows:
    """Rows one conversation after the other: kind of the role, whether the row must go, whether it is truncated, and how many
    equal rows, which must go, follow it."""

    kind: np.ndarray
    must: np.ndarray
    cut: np.ndarray
    more: np.ndarray

    def at(self, place: np.ndarray) -> Rows:
        return Rows(self.kind[place], self.must[place], self.cut[place], self.more[place])


def before(rows: Rows, after: np.ndarray) -> np.ndarray:
    """Cost vectors before these rows from those after them (rows x states)."""
    later = after + DELETE * rows.more[:, None]
    out = later + DELETE
    stays = np.where(rows.must, NEVER, TRUNCATED * rows.cut)
    user, assistant = later[:, USER] + stays, later[:, ASSISTANT] + stays
    to_user = user + np.where(rows.kind == USER, 0, RETELL)
    for q in (NOTHING, SYSTEM, ASSISTANT):
        out[:, q] = np.minimum(out[:, q], to_user)
    out[:, USER] = np.minimum(out[:, USER], assistant + np.where(rows.kind == ASSISTANT, 0, RETELL))
    out[:, NOTHING] = np.minimum(out[:, NOTHING], np.where(rows.kind == SYSTEM, later[:, SYSTEM] + stays, NEVER))
    return np.minimum(inserted(out), NEVER)


def inserted(v: np.ndarray) -> np.ndarray:
    """The vectors with inserts before what is next; of these a second in a row never saves another."""
    out = v.copy()
    out[:, USER] = np.minimum(v[:, USER], INSERT + v[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(v[:, ASSISTANT], INSERT + v[:, USER])
    for q in (NOTHING, SYSTEM):
        out[:, q] = np.minimum(v[:, q], INSERT + out[:, USER])
    return out


class Programme:
    """Several sequences of rows (of i from first[i] to first[i + 1]), each with the cost vector at its end."""

    def __init__(self, rows: Rows, first: np.ndarray, end: np.ndarray):
        self.rows, size = rows, np.diff(first)
        # Longest first, so that those with a row at a place are the first ones.
        self.order = np.argsort(-size, kind="stable")
        self.begin, self.end = first[:-1][self.order], end[self.order]
        self.longest = int(size.max(initial=0))
        self.live = np.searchsorted(-size[self.order], -np.arange(self.longest), side="left")
        self.every = isqrt(max(self.longest - 1, 0)) + 1
        self.marks: dict[int, np.ndarray] = {}
        v = self.end.copy()
        for p in range(self.longest - 1, -1, -1):
            if (p + 1) % self.every == 0:
                self.marks[p + 1] = v.copy()
            self._back(v, p)
        self.start = np.empty_like(v)
        self.start[self.order] = v

    def _back(self, v: np.ndarray, p: int) -> None:
        k = self.live[p]
        v[:k] = before(self.rows.at(self.begin[:k] + p), v[:k])

    def walk(self, entry: np.ndarray, finish: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edits from these states on: sequence, letter, row (-1: inserted), state after it (0: deleted); and the states at the ends.

        `finish`: also what is inserted after the last row.
        """
        state = entry[self.order].copy()
        out: list[tuple[np.ndarray, ...]] = []
        n = len(state)

        def emit(who: np.ndarray, letter: str, row: np.ndarray, role: np.ndarray) -> None:
            if len(who):
                out.append((who, np.full(len(who), ord(letter), np.uint8), row, role))

        def insert(who: np.ndarray, v: np.ndarray, row: np.ndarray | None, later: np.ndarray | None) -> None:
            while len(who):
                q = state[who]
                tight = v[who, q] == INSERT + v[who, NEXT[q]]
                if row is not None:
                    tight &= v[who, q] != DELETE * (1 + row.more[who]) + later[who, q]
                who = who[tight]
                state[who] = NEXT[state[who]]
                emit(who, "I", np.full(len(who), -1), state[who])

        for lo in range(0, self.longest, self.every):
            hi = min(lo + self.every, self.longest)
            v = self.marks.get(hi, self.end).copy()
            vectors = [v.copy()]
            for p in range(hi - 1, lo - 1, -1):
                self._back(v, p)
                vectors.append(v.copy())
            for p in range(lo, hi):
                here, later = vectors[hi - p], vectors[hi - p - 1]
                k = self.live[p]
                place, who = self.begin[:k] + p, np.arange(k)
                rows = self.rows.at(place)
                insert(who, here, rows, later)
                q, more = state[:k].copy(), DELETE * rows.more
                gone = here[who, q] == DELETE + more + later[who, q]
                stays, rest = TRUNCATED * rows.cut + more, here[who, q]
                same = np.where(rows.kind == SYSTEM, np.where(q == NOTHING, SYSTEM, -1), np.where((rows.kind > 0) & (rows.kind == NEXT[q]), rows.kind, -1))
                kept = ~gone & ~rows.must & (same >= 0) & (rest == stays + later[who, same])
                told = ~gone & ~kept
                state[:k] = np.where(kept, same, np.where(told, NEXT[q], q))
                for letter, which, role in (("D", gone, 0 * q), ("K", kept, same), ("R", told, NEXT[q])):
                    emit(who[which], letter, place[which], role[which])
                again = np.repeat(who, rows.more)
                emit(again, "D", np.repeat(place, rows.more), np.zeros(len(again), np.int64))
        if finish:
            insert(np.arange(n), self.end, None, None)
        who, letter, row, role = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (np.int64, np.uint8, np.int64, np.int64))
        left = np.empty_like(state)
        left[self.order] = state
        who = self.order[who]
        order = np.argsort(who, kind="stable")
        return who[order], letter[order], row[order], role[order], left


# ---- rows of a table


@dataclass
class Read:
    """Rows as the programme needs them, with what is counted of each."""

    rows: Rows
    initial: list[str]
    blank: np.ndarray
    duplicate: np.ndarray
    truncated: np.ndarray


def read(owner: np.ndarray, role: pa.Array, text: pa.Array, copies: np.ndarray, late: np.ndarray | None = None) -> Read:
    """`owner`: numbers of the conversations; `late`: rows whose role and text were seen before the first row here."""
    data, offsets = string_bytes(text)
    inside = np.flatnonzero(SPACED[data])
    upto = np.searchsorted(inside, offsets)
    blank = upto[1:] == upto[:-1]
    last = data[inside[np.maximum(upto[1:] - 1, 0)]] if len(inside) else np.zeros(len(blank), np.uint8)
    ended = np.isin(last, np.frombuffer(b".!?", np.uint8))
    roles, texts = role.dictionary_encode(), text.dictionary_encode()
    key = roles.indices.to_numpy().astype(np.int64) * (len(texts.dictionary) + 1) + texts.indices.to_numpy()
    order = np.lexsort((np.arange(len(key)), key, owner))
    seen = np.zeros(len(key), bool)
    seen[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    if late is not None:
        seen |= late
    seen &= ~blank
    initials = [r[:1] for r in roles.dictionary.to_pylist()]
    kind = np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(r, 0) for r in initials] or [0], np.int64)[roles.indices.to_numpy()]
    cut = ~blank & ~seen & ~ended
    more = copies - 1
    return Read(Rows(kind, blank | seen, cut, more), [initials[i] for i in roles.indices.to_pylist()], np.where(blank, copies, 0), np.where(blank, 0, more + seen), cut.astype(np.int64))


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def lines(letter: np.ndarray, row: np.ndarray, role: np.ndarray, roles: list[str], texts: list[str]) -> str | None:
    """The repaired rows of some edits; None if there are none."""
    out = []
    for x, i, r in zip(letter.tobytes().decode(), row.tolist(), role.tolist(), strict=True):
        if x != "D":
            out.append(f"{ROLES[r] if x != 'K' else roles[i]}:{texts[i] if i >= 0 else ''}")
    return "\n".join(out) if out else None


def repaired(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations in order (conv, turn, role, text, copies) to one row each."""
    table = table.combine_chunks()
    conv = table.column("conv").combine_chunks()
    number = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy() if conv.null_count or len(conv) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    names = conv.take(pa.array(first))
    owner_all = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(number)]))
    live = table.column("copies").to_numpy() > 0
    owner, table = owner_all[live], table.filter(pa.array(live))
    n = len(first)
    role, text = (table.column(c).combine_chunks() for c in ("role", "text"))
    found = read(owner, role, text, table.column("copies").to_numpy())
    bounds = np.searchsorted(owner, np.arange(n + 1))
    total = lambda x: np.bincount(owner, x, n).astype(np.int64)
    start = found.initial
    wrong = np.array([o == p and not legal(a, b) for o, p, a, b in zip(owner[:-1], owner[1:], start, start[1:], strict=False)], bool)
    illegal = np.bincount(owner[1:][wrong], minlength=n) + total(found.rows.more)
    turn = table.column("turn").combine_chunks()
    has = ~turn.is_null().to_numpy(zero_copy_only=False)
    value, who = turn.fill_null(0).to_numpy()[has], owner[has]
    gaps = np.zeros(n, np.int64)
    if len(value):
        begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        fresh = np.r_[True, (who[1:] != who[:-1]) | (value[1:] != value[:-1])]
        # Sorted by turn within each conversation.
        end = np.r_[begin[1:], len(value)] - 1
        gaps[who[begin]] = value[end] - value[begin] + 1 - np.add.reduceat(fresh.astype(np.int64), begin)
    programme = Programme(found.rows, bounds, np.repeat(FINAL[None], n, 0))
    who, letter, row, given, _ = programme.walk(np.zeros(n, np.int64), True)
    at = np.searchsorted(who, np.arange(n + 1))
    roles, texts = role.to_pylist(), text.to_pylist()
    audit = [letter[i:j].tobytes().decode() for i, j in zip(at, at[1:], strict=False)]
    digest = [hashlib.sha256((lines(letter[i:j], row[i:j], given[i:j], roles, texts) or "").encode()).hexdigest() for i, j in zip(at, at[1:], strict=False)]
    columns = [gaps, total(found.blank), total(found.duplicate), total(found.truncated), illegal, programme.start[:, NOTHING]]
    return pa.RecordBatch.from_arrays([names, *[pa.array(np.asarray(c, np.int64)) for c in columns], pa.array(audit), pa.array(digest)],
                                      ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, some at a time; one that goes on in the next batch waits."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        number = pc.dictionary_encode(table.column("conv").combine_chunks(), null_encoding="encode").indices.to_numpy()
        last = int(np.flatnonzero(np.r_[True, number[1:] != number[:-1]])[-1])
        if last:
            yield repaired(table.slice(0, last))
            table = table.slice(last)
        held, size = table.to_batches(), table.num_rows
    if held:
        yield repaired(pa.Table.from_batches(held))


# ---- conversations of many rows


def _sorted(table: pa.Table) -> pa.Table:
    keys = [("turn", "ascending"), ("role", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start")).combine_chunks()


def _packed(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _unpacked(row: dict) -> Rows:
    return Rows(np.frombuffer(row["kind"], np.int8).astype(np.int64), np.frombuffer(row["must"], bool), np.frombuffer(row["cut"], np.int8).astype(np.int64), np.frombuffer(row["more"], np.int64))


def _segment(table: pa.Table, late: pa.Table) -> pa.Table:
    """A range of a conversation: its rows for the programme, its matrix, and what is counted."""
    if not table.num_rows:
        return _schema(SEGMENT).empty_table()
    table = _sorted(table)
    known = set(late.column("known").to_pylist())
    seen = np.array([d in known for d in table.column("digest").to_pylist()], bool)
    found = read(np.zeros(table.num_rows, np.int64), *(table.column(c).combine_chunks() for c in ("role", "text")), table.column("copies").to_numpy(), seen)
    ends = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(ends, 0)
    r = found.rows
    four = Rows(*(np.tile(x, 4) for x in (r.kind, r.must, r.cut, r.more)))
    # Row j: the costs if the state at the end is j.
    matrix = Programme(four, np.arange(5) * len(r.kind), ends).start
    start = found.initial
    turn = table.column("turn").combine_chunks()
    value = turn.drop_null().to_numpy()
    row = {"num": table.column("num")[0].as_py(), "part": table.column("part")[0].as_py(), "kind": _packed(r.kind, np.int8), "must": _packed(r.must, bool), "cut": _packed(r.cut, np.int8),
           "more": _packed(r.more, np.int64), "matrix": matrix.ravel().tolist(), "low": int(value[0]) if len(value) else None, "high": int(value[-1]) if len(value) else None,
           "turns": int((np.diff(value) != 0).sum()) + 1 if len(value) else 0, "first": start[0], "last": start[-1],
           "blank": int(found.blank.sum()), "duplicate": int(found.duplicate.sum()), "truncated": int(found.truncated.sum()),
           "illegal": int(r.more.sum()) + sum(not legal(a, b) for a, b in zip(start, start[1:], strict=False))}
    return pa.Table.from_pylist([row], schema=_schema(SEGMENT))


SEGMENT = ("num bigint, part int, kind binary, must binary, cut binary, more binary, matrix array<bigint>, low bigint, high bigint, turns bigint, "
           "first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    """The Arrow schema of these columns; tasks cannot ask Spark for it."""
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _ends(table: pa.Table) -> pa.Table:
    """Of one conversation's ranges: the cost vector at each end, backward from the last; figures stand at the first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    v, ends = FINAL, []
    for r in reversed(rows):
        ends.append(v)
        v = np.minimum((np.array(r["matrix"], np.int64).reshape(4, 4) + v[:, None]).min(0), NEVER)
    turned = [r for r in rows if r["low"] is not None]
    joined = sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
    gaps = turned[-1]["high"] - turned[0]["low"] + 1 - (sum(r["turns"] for r in turned) - joined) if turned else 0
    figures = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": int(v[NOTHING])}
    figures["illegal"] += sum(not legal(a["last"], b["first"]) for a, b in zip(rows, rows[1:], strict=False))
    out = [{"num": r["num"], "part": r["part"], "end": e.tolist(), "last_part": r is rows[-1], **(figures if r is rows[0] else dict.fromkeys(figures))}
           for r, e in zip(rows, reversed(ends), strict=True)]
    return pa.Table.from_pylist(out, schema=_schema(ENDS))


ENDS = f"num bigint, part int, end array<bigint>, last_part boolean, {FIGURES}"


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that a range is left in for each that it is entered in."""
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            one = _unpacked(r)
            four = Rows(*(np.tile(x, 4) for x in (one.kind, one.must, one.cut, one.more)))
            made.append(Programme(four, np.arange(5) * len(one.kind), np.repeat(np.array([r["end"]], np.int64), 4, 0)).walk(np.arange(4), False)[4].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("num"), batch.column("part"), pa.array(made, pa.list_(pa.int64()))], ["num", "part", "exits"])


def _entries(table: pa.Table) -> pa.Table:
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["part"]), NOTHING, []
    for r in rows:
        out.append({"num": r["num"], "part": r["part"], "entry": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, schema=_schema("num bigint, part int, entry bigint"))


def _written(table: pa.Table, plan: pa.Table) -> pa.Table:
    """The edits and the repaired rows of a range."""
    if not table.num_rows or not plan.num_rows:
        return _schema(WRITTEN).empty_table()
    table, r = _sorted(table), plan.to_pylist()[0]
    rows = _unpacked(r)
    programme = Programme(rows, np.array([0, len(rows.kind)]), np.array([r["end"]], np.int64))
    _, letter, row, role, _ = programme.walk(np.array([r["entry"]]), r["last_part"])
    told = lines(letter, row, role, table.column("role").to_pylist(), table.column("text").to_pylist())
    return pa.Table.from_pylist([{"num": r["num"], "part": r["part"], "edits": letter.tobytes().decode(), "told": told}], schema=_schema(WRITTEN))


WRITTEN = "num bigint, part int, edits string, told string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order to one row for each conversation; only a digest's state and the edits are held."""
    num, digest, edits, some = None, hashlib.sha256(), [], False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([num]), pa.array(["".join(edits)]), pa.array([digest.hexdigest()])], ["num", "audit", "repaired_sha256"])

    for batch in batches:
        for n, e, told in zip(*(batch.column(c).to_pylist() for c in ("num", "edits", "told")), strict=True):
            if n != num:
                if num is not None:
                    yield row()
                num, digest, edits, some = n, hashlib.sha256(), [], False
            edits.append(e)
            if told is not None:
                digest.update((("\n" if some else "") + told).encode())
                some = True
    if num is not None:
        yield row()


def _large(rows: DataFrame, size: int, range_bytes: int) -> DataFrame:
    """num, figures, audit and digest of conversations whose rows are dealt out in ranges."""
    spark = rows.sparkSession
    once = rows.where("copies > 0").groupBy("num", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    parts = partitions_for(spark, size, range_bytes)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    ranged = saved(once.repartitionByRange(parts, "num", "turn", "role", "text").select("*", F.spark_partition_id().alias("part"), digest.alias("digest")))
    where = ranged.select("num", "part", "digest").distinct()
    first = where.groupBy("num", "digest").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    late = where.join(first, ["num", "digest"]).where("part > least").select(F.col("num").alias("of"), F.col("part").alias("there"), F.col("digest").alias("known"))
    segments = saved(ranged.groupBy("num", "part").cogroup(late.groupBy("of", "there")).applyInArrow(_segment, SEGMENT))
    ends = saved(segments.drop("kind", "must", "cut", "more").groupBy("num").applyInArrow(_ends, ENDS))
    walked = segments.select("num", "part", "kind", "must", "cut", "more").join(ends.select("num", "part", "end", "last_part"), ["num", "part"])
    entries = walked.mapInArrow(_exits, "num bigint, part int, exits array<bigint>").groupBy("num").applyInArrow(_entries, "num bigint, part int, entry bigint")
    plan = walked.join(entries, ["num", "part"])
    written = ranged.groupBy("num", "part").cogroup(plan.groupBy("num", "part")).applyInArrow(_written, WRITTEN)
    whole = written.repartition("num").sortWithinPartitions("num", "part").mapInArrow(_digested, "num bigint, audit string, repaired_sha256 string")
    return ends.where("cost IS NOT NULL").drop("part", "end", "last_part").join(whole, "num")


def repair(conversations: DataFrame, rows: DataFrame | None = None, conv_id: str = "conv_id", limit: int = ROWS, limit_bytes: int = BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each conversation: its id, figures, the edits' letters and a digest of the repaired rows.

    `rows`: (conv, turn, role, text, copies) to repair; by default the given ones, damaged.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = damaged(conversations, conv_id) if rows is None else rows
    size = F.octet_length("role") + F.octet_length("text")
    large = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(size).alias("bytes")).where((F.col("n") > limit) | (F.col("bytes") > limit_bytes))
    large = saved(large.withColumn("num", F.monotonically_increasing_id()))
    many, total = large.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    schema = struct(f"{FIGURES}, audit string, repaired_sha256 string")
    kind = rows.schema["conv"].dataType.simpleString()
    others, result = rows, None
    if many:
        # A row for each conversation of more than `limit` rows; Spark decides whether to broadcast them.
        own = large.select(F.col("conv").alias("__conv"), "num")
        others = rows.join(own, F.col("conv").eqNullSafe(F.col("__conv")), "left_anti")
        result = _large(rows.join(own, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv", "conv"), total, range_bytes)
        result = own.join(result, "num", "left").select(F.col("__conv").alias("conv"), *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in schema.names[:6]], F.coalesce("audit", F.lit("")).alias("audit"),
                                                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    ordered = others.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    found = ordered.mapInArrow(_stream, f"conv {kind}, {FIGURES}, audit string, repaired_sha256 string")
    found = found if result is None else found.unionByName(result)
    return found.withColumnRenamed("conv", conv_id)


def _oracle() -> str:
    """The contract as DuckDB SQL. Each state holds its cost (9 digits), its edits and, after a separator, its repaired rows, as one text:
    the least of two is the cheaper one, or of equal costs the one whose edits read less."""

    def step(v: str, cost: str, letter: str, line: str = "''") -> str:
        return f"lpad(CAST(CAST(left({v}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({v}, 10, strpos({v}, chr(1)) - 10) || '{letter}' || substr({v}, strpos({v}, chr(1))) || {line}"

    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    # A user may be inserted first, then an assistant.
    first = f"least(vu, {', '.join(step(v, '3', 'I', user) for v in ('v0', 'vs', 'va'))})"
    second = f"least(va, {step('iu', '3', 'I', assistant)})"
    may = lambda condition, v: f"CASE WHEN {condition} AND NOT must THEN {v} END"
    to_user = [may(c, step(v, cost, letter, line)) for v in ("v0", "vs", "ia") for c, cost, letter, line in (("x = 'u'", "add_", "K", own), ("true", "3 + add_", "R", f"{user} || text"))]
    to_assistant = [may("x = 'a'", step("iu", "add_", "K", own)), may("true", step("iu", "3 + add_", "R", f"{assistant} || text"))]
    stepped = (f"{step('v0', '4', 'D')} AS v0, least({step('vs', '4', 'D')}, {may(chr(120) + ' = ' + repr('s'), step('v0', 'add_', 'K', own))}) AS vs, "
               f"least({step('iu', '4', 'D')}, {', '.join(to_user)}) AS vu, least({step('ia', '4', 'D')}, {', '.join(to_assistant)}) AS va")
    closed = lambda source: f"(SELECT *, {second} AS ia FROM (SELECT *, {first} AS iu FROM {source}))"
    return rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind FROM keyed, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) r(c)),
numbered AS (SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS had, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM numbered),
faults AS (SELECT *, blank OR again AS must, CASE WHEN NOT blank AND NOT again AND open THEN 3 ELSE 0 END AS add_ FROM judged),
walk AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, '000000000' || chr(1) AS v0, CAST(NULL AS VARCHAR) AS vs, CAST(NULL AS VARCHAR) AS vu, CAST(NULL AS VARCHAR) AS va FROM conversations
  UNION ALL
  SELECT w.conv_id, w.i + 1, {stepped} FROM {closed('walk')} w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i),
ended AS (SELECT conv_id, least(v0, ia) AS v FROM {closed('(SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)')}),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (add_ > 0) AS truncated, count(*) FILTER (had IS NOT NULL AND had || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(v, 9) AS BIGINT) AS cost, substr(v, 10, strpos(v, chr(1)) - 10) AS audit, sha256(substr(v, strpos(v, chr(1)) + 2)) AS repaired_sha256
FROM ended e LEFT JOIN figures g ON g.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE = _oracle()
