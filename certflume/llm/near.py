"""Near-duplicates by MinHash bands and odd sketches.

1. Each document's set of word shingles gives its size, a digest, MinHash values
   in bands, and an odd sketch: every MinHash sample toggles one bit, so the
   sketches of similar sets differ in few bits and their XOR's population count
   gives the similarity. Equal sets are one class from here on.
2. In every band bucket each class meets the bucket's smallest one. Sketches drop pairs
   that are clearly apart; the rest is confirmed on the full sets.
3. Confirmed links make components. Where a bucket still holds classes of different
   components, those outside its largest are compared with all, block against block:
   by sketch, then on full sets. So no link depends on who happened to be smallest,
   a group of copies that is already one component costs no pairs, and no pair is a row
   before it is a link.
4. Components again, and every document gets its class's.

A bucket is never one list in one task unless its classes are still apart, and
then it is cut into blocks. With 32 bands of 4 rows a pair at the threshold of
0.8 is missed with a probability of 5e-8; the sketch's margin is six deviations.

Nulls: null, empty and wordless texts have an empty set, size 0, and are linked
with nothing. Rows with a null id are components of their own with a null
component_id, and kept. Repeated rows get equal results; rows with one id but
unlike texts are documents of their own, each in its own component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import extend, noded, partitions_for, quoted, renamed_nodes, saved, struct, total_bytes
from .text import CHECK_SEED, SEED, SPACED, Words, mix, slices, window_hashes, words

BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: Six standard deviations of a similarity estimated by BANDS * ROWS samples.
MARGIN = 6
#: Classes of a bucket that are compared with each other in one block; members of a centre that one task confirms.
BLOCK, MEMBERS = 1024, 256
GROUP_BYTES = 8 << 20

_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


# ---- sets and their signatures


def shingles(w: Words, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of all documents, sorted within each; and where each document's begin."""
    value, doc, count = w.hashes(seed), w.doc(), w.counts
    grams = window_hashes(value, k)
    last = w.first[1:][doc[:len(grams)]]
    whole = np.arange(len(grams)) + k <= last
    docs, sets = [doc[:len(grams)][whole]], [grams[whole]]
    # Documents of fewer words: the whole sequence as one shingle.
    for n in range(1, k):
        few = np.flatnonzero(count == n)
        if len(few):
            docs.append(few)
            sets.append(window_hashes(value, n)[w.first[:-1][few]] ^ np.uint64(n))
    doc, value = np.concatenate(docs), np.concatenate(sets)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirmed_again(a: pa.Array, b: pa.Array, k: int, percent: int) -> bool:
    """The same for two texts by hashes of another seed: 128 bits stand for a shingle of a link."""
    return _similar(*(shingles(words(x, SPACED, True), k, CHECK_SEED)[0] for x in (a, b)), percent)


def signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per set: two digest halves, bands (sets x BANDS) and odd sketch (sets x bytes). Empty sets have zeros."""
    docs = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    at = first[:-1][full]
    digest = np.zeros((docs, 2), np.uint64)
    least = np.zeros((docs, BANDS * ROWS), np.uint32)
    if len(full):
        for i, salt in enumerate((0x1234567, 0x89ABCDEF)):
            digest[full, i] = np.add.reduceat(mix(value ^ np.uint64(salt)), at)
        short = (value >> np.uint64(32)).astype(np.uint32)
        for i in range(BANDS * ROWS):
            least[full, i] = np.minimum.reduceat(short * FACTORS[i] + SHIFTS[i], at)
    h = np.full((docs, BANDS), 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS].astype(np.uint64))
    bit = (mix(least.astype(np.uint64) + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((np.arange(docs)[:, None] * SKETCH_BITS + bit).ravel(), minlength=docs * SKETCH_BITS).reshape(docs, SKETCH_BITS) & 1
    return digest[:, 0], digest[:, 1], h, np.packbits(odd.astype(np.uint8), axis=1)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from odd sketches, rows of a against rows of b."""
    differ = np.bitwise_count(a ^ b).sum(-1)
    # A set of n differing samples toggles m(1 - (1 - 2/m)^n)/2 of m bits.
    share = np.clip(1 - 2 * differ / SKETCH_BITS, 1e-9, 1)
    n = np.log(share) / np.log(1 - 2 / SKETCH_BITS)
    # Each sample that differs is two toggles.
    return 1 - n / (2 * BANDS * ROWS)


def loosest(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def signature_table(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        value, first = shingles(words(batch.column("__text"), SPACED, True), k)
        a, b, h, sketch = signatures(value, first)
        return [pa.array(np.diff(first).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                pa.array([r.tobytes() for r in h], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())]

    own = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("t"))
    return extend(own, "t", make, struct("n_shingles bigint, d1 bigint, d2 bigint, bands binary, sketch binary"), keep=["doc_id"])


# ---- candidates


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, c) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                h = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(part.column("c").to_numpy(), BANDS))], ["band", "c"])

    return classes.select("c", "bands").mapInArrow(run, "band bigint, c bigint")


def passing(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sketches do not rule the similarity out."""
    least = loosest(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
            keep = pa.array(estimated(*sketch) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    s = classes.select("c", "sketch")
    one = pairs.join(s.select(F.col("c").alias("a"), F.col("sketch").alias("sa")), "a")
    return one.join(s.select(F.col("c").alias("b"), F.col("sketch").alias("sb")), "b")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """The pairs (a < b) whose full sets have 100 * intersection >= percent * union.

    Texts travel, not sets, as they are smaller. A centre `a` with many partners is
    dealt out in parts, each with its own copy of the centre's text.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS).cast("long"))
    dealt = pairs.join(many, "a").select("a", "b", part.alias("part")).withColumn("g", F.pmod(F.xxhash64("a", "part"), F.lit(groups)).cast("int"))
    partners = dealt.join(texts.withColumnRenamed("c", "b"), "b").select("g", "a", "part", "b", "t")
    centres = dealt.select("g", "a", "part").distinct().join(texts.withColumnRenamed("c", "a"), "a").select(F.col("g").alias("h"), F.col("a").alias("centre"), F.col("part").alias("portion"), F.col("t").alias("text"))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("a", "ascending"), ("part", "ascending")])
            keys = list(zip(left.column("a").to_pylist(), left.column("part").to_pylist(), strict=True))
            place = {x: i for i, x in enumerate(zip(right.column("centre").to_pylist(), right.column("portion").to_pylist(), strict=True))}
            centre, here = None, None
            b = left.column("b").to_pylist()
            done = 0
            for batch in slices(iter(left.select(["t"]).combine_chunks().to_batches()), "t"):
                value, first = shingles(words(batch.column("t"), SPACED, True), k)
                for d in range(batch.num_rows):
                    key = keys[done]
                    if key != here:
                        here = key
                        centre_text = right.column("text").slice(place[key], 1).combine_chunks()
                        centre = shingles(words(centre_text, SPACED, True), k)[0]
                    own = value[first[d]:first[d + 1]]
                    if _similar(own, centre, percent) and confirmed_again(batch.column("t").slice(d, 1), centre_text, k, percent):
                        out_a.append(key[0])
                        out_b.append(b[done])
                    done += 1
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return partners.groupBy("g").cogroup(centres.groupBy("h")).applyInArrow(check, "a bigint, b bigint")


# ---- components


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(c, component): the smallest id reachable over links (a, b), for ids that have any.

    Labels spread along links and jump to their labels' labels; every round is written,
    and all steps are joins and minima, so a hub is never one list. `tasks`: so many write and read a round, if
    that is fewer than the partitions it was shuffled to.
    """
    kept = lambda df: saved(df if tasks is None else df.coalesce(tasks))
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("l")))
    while True:
        heard = both.join(labels.select(F.col("c").alias("a"), "l"), "a").groupBy(F.col("b").alias("c")).agg(F.min("l").alias("m"))
        near = labels.join(heard, "c").select("c", F.col("l").alias("old"), F.least("l", "m").alias("n"))
        jump = labels.select(F.col("c").alias("n"), F.col("l").alias("far"))
        step = kept(near.join(jump, "n", "left").select("c", "old", F.least("n", F.coalesce("far", "n")).alias("l")))
        labels = step.select("c", "l")
        if step.where("l <> old").isEmpty():
            return labels.select("c", F.col("l").alias("component"))


# ---- pairs across components


def across(bands: DataFrame, classes: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between classes of one bucket and different components.

    Of a bucket's components the largest is not compared with itself: its members are cut into
    blocks, each of which meets the others; these, mostly few, meet each other too. A pair is
    looked at in the first band that it shares. Inside a block pairs that the sketches let
    pass are confirmed on full sets, most similar first; once a link is found between two
    components, their other pairs decide nothing and are left. So only links are rows.
    """
    least = loosest(percent / 100)
    labelled = bands.join(found, "c", "left").select("band", "c", F.coalesce("component", "c").alias("component"))
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    # Of a bucket of two the one pair was a star.
    open_ = (sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
             .where("kinds > 1 AND all > 2").select("band", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("n")) / BLOCK).cast("int").alias("others")))
    rows = labelled.join(open_, "band").withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meets = F.when(F.col("is_main"), F.transform(span("others"), lambda j: place(0, F.col("own"), j))).otherwise(F.concat(
        F.transform(span("mains"), lambda i: place(0, i, F.col("own"))), F.transform(span("others"), lambda t: place(1, F.least("own", t), F.greatest("own", t)))))
    rows = rows.select("band", "c", "component", "is_main", "own", F.inline(meets))
    rows = rows.join(classes, "c").join(texts, "c")

    def compare(table: pa.Table) -> pa.Table:
        c, comp, own, main = (table.column(x).to_numpy() for x in ("c", "component", "own", "is_main"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(c), -1).view(np.uint64)
        band = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(len(c), -1)
        kind, i, j, here = (table.column(x)[0].as_py() for x in ("kind", "i", "j", "band"))
        left = np.flatnonzero(main if kind == 0 else own == i)
        right = np.flatnonzero(~main if kind == 0 else own == j)
        pairs: list[tuple[np.ndarray, ...]] = []
        for x in right:
            apart = left[comp[left] != comp[x]]
            if kind and i == j:
                apart = apart[c[apart] < c[x]]
            first = (band[apart] == band[x]).argmax(1)
            apart = apart[band[x][first] == here]
            likely = estimated(sketch[apart], sketch[x])
            keep = likely >= least
            pairs.append((likely[keep], apart[keep], np.full(int(keep.sum()), x)))
        out: list[tuple[int, int]] = []
        if pairs:
            likely, a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            parent: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            def text_of(x: int) -> pa.Array:
                return table.column("t").slice(x, 1).combine_chunks()

            def full(x: int) -> np.ndarray:
                if x not in sets:
                    sets[x] = shingles(words(text_of(x), SPACED, True), k)[0]
                return sets[x]

            for n in np.lexsort((b, a, -likely)).tolist():
                x, y = int(a[n]), int(b[n])
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    if _similar(full(x), full(y), percent) and confirmed_again(text_of(x), text_of(y), k, percent):
                        parent[max(p, q)] = min(p, q)
                        out.append((min(int(c[x]), int(c[y])), max(int(c[x]), int(c[y]))))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("band", "kind", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`."""
    nodes = noded(docs, doc_id, text)
    if nodes is not None:
        found = renamed_nodes(clusters(nodes, "__node", "__text", shingle, percent).drop("kept"), nodes)
        return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    threshold = percent / 100
    groups = partitions_for(docs.sparkSession, total_bytes(docs, text), GROUP_BYTES)
    sigs = saved(signature_table(docs, doc_id, text, shingle))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    set_key = ["n_shingles", "d1", "d2"]
    smallest = full.groupBy(*set_key).agg(F.min("doc_id").alias("c"))
    # One row for each class; a repeated row of its first document would be a second one.
    classes = (full.join(smallest.select(*[F.col(x).alias(f"k_{x}") for x in set_key], "c"), [full[x].eqNullSafe(F.col(f"k_{x}")) for x in set_key] + [full["doc_id"] == F.col("c")])
               .groupBy("c").agg(F.min(F.struct("d1", "d2", "bands", "sketch")).alias("s")).select("c", "s.bands", "s.sketch"))
    classes = saved(classes)
    every = band_rows(classes)
    shared = every.groupBy("band").agg(F.min("c").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = saved(every.join(shared.select("band", "a"), "band").select("band", "c", "a"))
    tried = bands.where("a < c").select("a", F.col("c").alias("b")).distinct()
    stars = saved(sketched(tried, classes).select("a", "b", "sa", "sb"))
    texts = docs.select(F.col(quoted(doc_id)).cast("long").alias("c"), F.col(quoted(text)).cast("string").alias("t")).where("c IS NOT NULL")
    links = saved(confirmed(passing(stars, threshold), texts, shingle, percent, groups))
    found = components(links)
    crossing = saved(across(bands.select("band", "c"), classes, found, texts, shingle, percent))
    if not crossing.isEmpty():
        found = components(links.unionByName(crossing))
    named = smallest.join(found, "c", "left").select(*set_key, F.coalesce("component", "c").alias("component"))
    judged = sigs.join(named, set_key, "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = judged.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The contract of op7 as DuckDB SQL, for tables of a few thousand documents.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
