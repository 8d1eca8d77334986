"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

1. Documents are shuffled by their full text; each distinct text is tokenized and
   aligned once, however many documents hold it, and remembers how many those are.
2. Byte offsets at which tokens of both sides end cut a text into groups. Every
   token of one side is linked with every token of the other in its group.
3. The documents that hold a pair of ids linked are counted: every task adds up
   its texts' pairs, each weighted by the number of its documents, before a shuffle.
4. Counts return to the texts' links, and the measures to the documents by a
   digest of the text.

The pairs' table has one row for each two ids that were ever linked, so it is
bounded by the vocabularies, not by the corpus; it is broadcast in blocks of
`BLOCK_PAIRS` rows, and further blocks are further passes over the stored links.

Where no token of either side can reach over a single space between two other
characters, a text is a sequence of units cut there; a task remembers the groups
of each unit that it met, so a frequent word is tokenized once.

Nulls: texts that are null or empty have no tokens, nor have texts that either
side does not give back byte by byte: all their measures are zero. Repeated rows
are documents of their own. Rows with a null id are measured like others.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import quoted, shared_folder, shipped, small_batches, without
from .text import slices, string_bytes

#: Rows of the pairs' table that are broadcast at a time; pairs that a task holds; pairs that are made at a time.
BLOCK_PAIRS, HELD_PAIRS, STEP_PAIRS = 2_000_000, 1_000_000, 2_000_000
#: Links of a group beyond which repeated ids are counted first.
LARGE_GROUP = 256
#: Bytes of texts that are aligned together; units that a task remembers before it forgets those met once, and bytes of these.
BATCH_BYTES, UNITS, UNIT_BYTES = 500_000, 600_000, 32 << 20
SPACE = "▁"

MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """Of a byte-level vocabulary: the byte that each letter stands for. Printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabularies:
    """Two vocabularies as their files' contents: byte-level BPE (JSON) and SentencePiece."""

    a_file: bytes
    b_file: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Vocabularies:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def a_bytes(self) -> list[bytes]:
        """The bytes of each id of A; special tokens have none."""
        held = json.loads(self.a_file)
        letters = byte_letters()
        special = {t["id"] for t in held["added_tokens"]}
        listed = sorted(held["model"]["vocab"].items(), key=lambda x: x[1])
        out = [b""] * (max([i for _, i in listed] + list(special)) + 1)
        for token, i in listed:
            if i not in special:
                out[i] = bytes(letters[c] for c in token)
        return out

    @cached_property
    def a(self):
        """An encoder of A. As each merge makes the next id, ids are ranks, which a faster library reads with the same result."""
        import tiktoken
        from tokenizers import pre_tokenizers

        held = json.loads(self.a_file)
        model, pre = held["model"], held["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ordered = all(x < y for x, y in pairwise(model["vocab"][p + q] for p, q in merges))
        own = pre_tokenizers.ByteLevel(add_prefix_space=False)
        if held["normalizer"] or model["dropout"] or model.get("ignore_merges") or not ordered or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or own.use_regex is False:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            plain = Tokenizer.from_str(self.a_file.decode())
            plain.encode_special_tokens = True
            return lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        # The words that byte-level vocabularies of this kind are cut into, a fixed pattern.
        words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {b: i for i, b in enumerate(self.a_bytes) if b}
        coder = tiktoken.Encoding("a", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_file)

    @cached_property
    def b_bytes(self) -> list[bytes]:
        b = self.b
        return [b"" if b.is_control(i) or b.is_unused(i) else bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode()
                for i in range(b.get_piece_size())]

    @cached_property
    def may_cut(self) -> bool:
        """No piece of B reaches over a space, spaces are kept, and one is put in front."""
        from sentencepiece import sentencepiece_model_pb2 as formats

        proto = formats.ModelProto()
        proto.ParseFromString(self.b_file)
        n = proto.normalizer_spec
        return (n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap
                and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces))

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A one text after the other, where each text's begin, and the same of B."""
        out: list[np.ndarray] = []
        for ids in (self.a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            out += [np.fromiter(chain.from_iterable(ids), np.int64), np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)]
        return tuple(out)

    @cached_property
    def memory(self) -> Units:
        return Units(self)

    @cached_property
    def spellings(self) -> tuple[pa.Array, pa.Array]:
        return tuple(pa.array(side, pa.large_binary()) for side in (self.a_bytes, self.b_bytes))

    def spelled(self, ids: np.ndarray, side: int) -> bytes:
        """The bytes of these ids, one after the other."""
        return (self.spellings[side].take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")).to_pybytes()


@dataclass
class Aligned:
    """Of a batch of texts, one after the other: ids of both sides and the group of each, and where each text's begin.

    Texts that are not given back byte by byte have nothing.
    """

    a: np.ndarray
    a_group: np.ndarray
    a_first: np.ndarray
    b: np.ndarray
    b_group: np.ndarray
    b_first: np.ndarray
    group_first: np.ndarray

    def links(self) -> np.ndarray:
        """How many links each group has."""
        n = int(self.group_first[-1])
        return np.bincount(self.a_group, minlength=n) * np.bincount(self.b_group, minlength=n)

    def written(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text."""
        n = int(self.group_first[-1])
        sides = []
        for ids, group in ((self.a, self.a_group), (self.b, self.b_group)):
            offsets = np.searchsorted(group, np.arange(n + 1)).astype(np.int32)
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids).cast(pa.string())), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.group_first.astype(np.int32)), groups), ";").to_pylist()

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text as (text, a * width + b), and how many links each has."""
        n = int(self.group_first[-1])
        text = np.searchsorted(self.group_first, np.arange(n), side="right") - 1
        place = np.arange(n + 1)
        ids, at = [self.a, self.b], [np.searchsorted(self.a_group, place), np.searchsorted(self.b_group, place)]
        found: list[tuple[np.ndarray, ...]] = []
        large = np.diff(at[0]) * np.diff(at[1]) > LARGE_GROUP
        for part, of, bounds, many in self._parts(ids, at, large):
            size = np.where(part, np.diff(bounds[0]) * np.diff(bounds[1]), 0)
            total = np.r_[0, np.cumsum(size)]
            # No more than STEP_PAIRS (or one group) are spread out at a time.
            cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) + STEP_PAIRS, STEP_PAIRS)).clip(0, n))
            for lo, hi in pairwise(cuts.tolist()):
                group = np.repeat(np.arange(lo, hi), size[lo:hi])
                step = np.arange(len(group)) - (total[group] - total[lo])
                across = (bounds[1][1:] - bounds[1][:-1])[group]
                row = step // across
                i, j = bounds[0][group] + row, bounds[1][group] + step - row * across
                times = np.ones(len(i), np.int64) if many is None else many[0][i] * many[1][j]
                found.append(_summed(text[group], of[0][i] * width + of[1][j], times))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    @staticmethod
    def _parts(ids, at, large):
        """Small groups as they are; in large ones repeated ids are one with a count, so a long stretch of one token stays small."""
        if not large.all():
            yield ~large, ids, at, None
        if large.any():
            places = np.flatnonzero(large)
            of, bounds, many = [], [], []
            for own, first in zip(ids, at, strict=True):
                n = np.diff(first)[places]
                pick = np.repeat(first[places] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                key, times = np.unique(np.repeat(places, n) << 32 | own[pick], return_counts=True)
                of.append(key & 0xFFFFFFFF)
                bounds.append(np.searchsorted(key >> 32, np.arange(len(large) + 1)))
                many.append(times)
            yield large, of, bounds, many


def _summed(text: np.ndarray, pair: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of a text as one. The texts of a batch are few, so text and pair are one number."""
    order = np.argsort(text * (int(pair.max(initial=0)) + 1) + pair, kind="stable")
    text, pair, many = text[order], pair[order], many[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]) if len(pair) else np.zeros(0, np.int64)
    return text[new], pair[new], np.add.reduceat(many, new) if len(new) else many


def aligned(texts: list[str], v: Vocabularies) -> Aligned:
    """Align a batch of texts."""
    a, a_first, b, b_first = v.encode(texts)
    given = [b" " + t.encode() for t in texts]
    good = [bool(t) for t in texts]
    for side, (ids, first) in enumerate(((a, a_first), (b, b_first))):
        raw, at = v.spelled(ids, side), np.r_[0, np.cumsum(v.lengths[side][ids])][first].tolist()
        good = [g and raw[i:j] == x for g, x, (i, j) in zip(good, given, pairwise(at), strict=True)]
    keep = np.array(good, bool)
    out = []
    for ids, first, length in ((a, a_first, v.lengths[0]), (b, b_first, v.lengths[1])):
        count = np.where(keep, np.diff(first), 0)
        ids = ids[np.repeat(keep, np.diff(first))]
        out.append((ids, np.r_[0, np.cumsum(count)], np.cumsum(length[ids])))
    # Both sides spell the same bytes, so the ends of texts are common ends, too.
    common = np.intersect1d(out[0][2], out[1][2], assume_unique=True)
    ends = np.r_[0, np.cumsum([len(x) if k else 0 for x, k in zip(given, good, strict=True)])]
    group_first = np.searchsorted(common, ends, side="right").astype(np.int64)
    (a, a_first, a_end), (b, b_first, b_end) = out
    return Aligned(a, np.searchsorted(common, a_end), a_first, b, np.searchsorted(common, b_end), b_first, group_first)


class Units:
    """What is known of units: whether both sides give them back, their figures, groups as text, and linked pairs."""

    FIGURES = 4

    def __init__(self, v: Vocabularies):
        self.v, self.width = v, len(v.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.uses = np.zeros(0, np.int32)
        self.good = np.zeros(0, bool)
        self.figures = np.zeros((0, self.FIGURES), np.int64)
        self.groups = pa.array([], pa.large_string())
        self.pair = self.times = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep what was met again, if that is half of what there is room for or less."""
        stay = np.flatnonzero(self.uses > 1)
        listed = list(self.place)
        kept = [listed[i] for i in stay.tolist()]
        size = sum(map(len, kept))
        if len(kept) > UNITS // 2 or size > UNIT_BYTES // 2:
            return self.clear()
        n = self.first[stay + 1] - self.first[stay]
        pick = np.repeat(self.first[stay] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        self.place, self.bytes = {u: i for i, u in enumerate(kept)}, size
        self.uses, self.good, self.figures, self.groups = np.zeros(len(stay), np.int32), self.good[stay], self.figures[stay], self.groups.take(pa.array(stay))
        self.pair, self.times, self.first = self.pair[pick], self.times[pick], np.r_[0, np.cumsum(n)]

    def known(self, units: list[bytes]) -> np.ndarray:
        """The places of these units, each with its leading space; new ones are aligned."""
        new = [u for u in units if u not in self.place]
        if len(self.place) + len(new) > UNITS or self.bytes + sum(map(len, new)) > UNIT_BYTES:
            self.forget()
            new = [u for u in units if u not in self.place]
        if new:
            texts = [u[1:].decode() for u in new]
            found = aligned(texts, self.v)
            n = len(new)
            links = np.r_[0, np.cumsum(found.links())]
            which, pair, times = found.pairs(self.width)
            counts = np.stack([np.diff(found.a_first), np.diff(found.b_first), np.diff(found.group_first), links[found.group_first[1:]] - links[found.group_first[:-1]]], 1)
            self.place.update(zip(new, range(len(self.good), len(self.good) + n), strict=True))
            self.bytes += sum(map(len, new))
            self.good, self.uses = np.r_[self.good, counts[:, 0] > 0], np.r_[self.uses, np.zeros(n, np.int32)]
            self.figures = np.concatenate([self.figures, counts])
            self.groups = pa.concat_arrays([self.groups, pa.array(found.written(), pa.large_string())])
            self.first = np.r_[self.first, self.first[-1] + np.searchsorted(which, np.arange(1, n + 1))]
            self.pair, self.times = np.r_[self.pair, pair], np.r_[self.times, times]
        at = np.array([self.place[u] for u in units], np.int64)
        self.uses[at] += 1
        return at


@dataclass
class Measured:
    """Of a batch of texts: figures (texts x 4), groups as text, and the linked pairs of text i from first[i] to first[i + 1]."""

    figures: np.ndarray
    groups: list[str]
    pair: np.ndarray
    times: np.ndarray
    first: np.ndarray


def unit_starts(data: np.ndarray, first: np.ndarray, may_cut: bool) -> np.ndarray:
    """Where units begin: texts do, and single spaces between two other ASCII characters that are seen."""
    start = np.zeros(len(data) + 1, bool)
    start[first] = True
    if may_cut and len(data) > 2:
        seen = (data > 0x20) & (data < 0x7F)
        start[1:-2] |= (data[1:-1] == 0x20) & seen[:-2] & seen[2:]
    return np.flatnonzero(start)


def measured(array: pa.Array, v: Vocabularies) -> Measured:
    """Align texts that are neither null nor empty."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), array.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    data, first = string_bytes(spaced)
    bounds = unit_starts(data, first, v.may_cut)
    units = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    memory, n = v.memory, len(array)
    place = memory.known(units.dictionary.to_pylist())[units.indices.to_numpy()]
    text_first = np.searchsorted(bounds, first)
    text = np.repeat(np.arange(n), np.diff(text_first))
    good = np.ones(n, bool)
    good[text[~memory.good[place]]] = False
    place, text = place[good[text]], text[good[text]]
    figures = np.zeros((n, Units.FIGURES), np.int64)
    text_first = np.searchsorted(text, np.arange(n + 1))
    if len(place):
        figures[good] = np.add.reduceat(memory.figures[place], text_first[:-1][good])
    groups = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(text_first), memory.groups.take(pa.array(place))), pa.scalar(";", pa.large_string())).to_pylist()
    size = (memory.first[place + 1] - memory.first[place])
    pick = np.repeat(memory.first[place] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    which, pair, times = _summed(np.repeat(text, size), memory.pair[pick], memory.times[pick])
    return Measured(figures, groups, pair, times, np.searchsorted(which, np.arange(n + 1)))


# ---- Spark


def text_key(text: str):
    return F.unhex(F.sha2(F.col(quoted(text)).cast("string").cast("binary"), 256))


def _once(docs: DataFrame, v: Vocabularies, text: str) -> DataFrame:
    """Each distinct text's measures of its own and its linked pairs: (key, copies, n_a, ..., pairs, times)."""
    small_batches(docs.sparkSession)
    sent = shipped(docs.sparkSession, v)
    distinct = docs.select(F.col(quoted(text)).cast("string").alias("t")).where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    rows = distinct.select(text_key("t").alias("key"), "copies", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in slices(batches, "t", BATCH_BYTES):
            found = measured(batch.column("t"), own)
            offsets = pa.array(found.first.astype(np.int32))
            digest = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in found.groups]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("copies"), *[pa.array(x) for x in np.ascontiguousarray(found.figures.T)], pa.array(digest),
                pa.ListArray.from_arrays(offsets, pa.array(found.pair)), pa.ListArray.from_arrays(offsets, pa.array(found.times))],
                ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return rows.mapInArrow(run, f"key binary, copies bigint, {MEASURES}, pairs array<bigint>, times array<bigint>")


def _counted(once: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])

        for batch in batches:
            pairs = batch.column("pairs")
            held.append((pairs.flatten().to_numpy(), np.repeat(batch.column("copies").to_numpy(), pairs.value_lengths().to_numpy())))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield out()
                    held, size = [], 0
        if held:
            held = [merged()]
            yield out()

    return once.select("copies", "pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): whether no other pair of its id of A has more."""
    own = counts.withColumn("a", F.expr(f"pair div {width}"))
    # One row for each id of A.
    most = own.groupBy("a").agg(F.max("n").alias("most"))
    return own.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, v: Vocabularies, text: str = "text") -> DataFrame:
    """(a, b, n, best): ids of both sides, in how many documents they are linked, and whether b is a commonest partner of a."""
    width = len(v.b_bytes)
    found = _ranked(_counted(_once(docs, v, text)), width)
    return found.select(F.expr(f"cast(pair div {width} AS int)").alias("a"), F.expr(f"cast(pair % {width} AS int)").alias("b"), "n", "best")


def measure(docs: DataFrame, v: Vocabularies, text: str = "text", keep: list[str] | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Every row with RESULTS: tokens of both sides, groups, links, links whose count is the highest of their id of A, the
    sum of the links' counts, and a digest of the groups. Columns of these names are replaced."""
    spark = docs.sparkSession
    folder, counts = shared_folder(spark, "alignment-links"), shared_folder(spark, "alignment-counts")
    _once(docs, v, text).write.option("compression", "zstd").parquet(folder)
    once = spark.read.parquet(folder)
    _ranked(_counted(once), len(v.b_bytes)).write.parquet(counts)
    ranked = spark.read.parquet(counts)
    blocks = max(1, -(-ranked.count() // block_pairs))
    sums = None
    for b in range(blocks):
        part = ranked if blocks == 1 else ranked.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == b)
        table = part.toArrow().sort_by("pair")  # block_pairs rows, give or take
        sent = spark.sparkContext.broadcast((table.column("pair").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy()))
        step = _looked_up(once, sent)
        sums = step if sums is None else sums.unionByName(step)
    if blocks > 1:
        sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"),
                                       *[F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")])
    own = docs if keep is None else docs.select(*[quoted(c) for c in keep], *([quoted(text)] if text not in keep else []))
    packed = without(own, RESULTS)
    names = [c for c in packed.columns if keep is None or c in keep]
    rows = packed.select(F.struct(*[quoted(c) for c in names]).alias("__doc"), F.when(F.col(quoted(text)).cast("string") != "", text_key(text)).alias("__key"))
    joined = rows.join(sums.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left")
    zero = [F.coalesce(F.col(c), F.lit("") if c == "groups_sha256" else F.lit(0).cast("long")).alias(c) for c in RESULTS]
    return joined.select(*[F.col("__doc")[c].alias(c) for c in names], *zero)


def _looked_up(once: DataFrame, sent) -> DataFrame:
    """The measures with what one block of the pairs' table adds to n_best and count_sum."""
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for batch in batches:
            pairs = batch.column("pairs")
            flat, times = pairs.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            at, times, row = at[hit], times[hit], row[hit]
            # Whole numbers, so that sums of any size are exact.
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * count[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums[0]), pa.array(sums[1])], [*names, "n_best", "count_sum"])

    return once.select(*names, "pairs", "times").mapInArrow(run, f"key binary, {MEASURES}, n_best bigint, count_sum bigint")
