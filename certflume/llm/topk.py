"""Exact top-k by distributed histogram selection.

Queries are taken in blocks of a fixed size; a block is broadcast and every
candidate is scored against it. No scores are kept: each round rescans the
candidates, counts scores per query in the bins of a range that is known to hold
its k-th value, and narrows the range to one bin, until a bin is one integer.
Then only scores from the k-th value up are rows. A task reports its k highest
bins only, which is enough, as the global k-th value is no lower than any
task's; of the ties at the k-th value it reports its k smallest ids. So what
is shuffled per query and task is bounded, however many rows are equal.

Nulls: vectors that are null, or hold null or non-finite components, or have a null
id, take no part. Rows that share an id, equal or not, are rows of their own, as queries and as
candidates of each other; of equal ones no more than can be shown are scored. Vectors of another
length than the query's are no candidates of it. Scores beyond what a long holds are given as its limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import quoted, saved

BINS = 1024
#: Components are taken in units of 1 / SCALE.
SCALE = 256
#: Queries that are broadcast at a time, and candidates scored at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
LONG = (-(1 << 63), (1 << 63) - 1)


def finite(vector: Column) -> Column:
    """The components as doubles; null if any is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~F.exists(x, bad), x)


def matrix(column: pa.Array, n: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: as longs, or as whole numbers of any size where these are too small."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if np.abs(flat).max(initial=0) < 2 ** 52 / scale:
        return np.floor(flat * scale).astype(np.int64).reshape(n, -1)
    # A double of 2 ** 53 or more is a whole number.
    large = [math.floor(x * scale) if abs(x) < 2 ** 53 else int(x) * scale for x in flat.tolist()]
    return np.array(large, object).reshape(n, -1)


def sizes(a: np.ndarray) -> np.ndarray:
    """Absolute values as floating point; what is beyond any long need not be told apart."""
    return np.array([float(min(abs(x), 1 << 64)) for x in a.ravel().tolist()]).reshape(a.shape) if a.dtype == object else np.abs(a.astype(np.float64))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products. Floating point where every sum is exact in it, whole numbers of any size elsewhere; held in a long."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = sizes(q).max() * sizes(c).max() * q.shape[1]
    if most < 2 ** 52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, *LONG).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids and vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            yield part.column(0).to_numpy(), part.column(2).to_numpy(), matrix(part.column(1), part.num_rows) if dim else np.zeros((part.num_rows, 0), np.int64)


def _own(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs of a query with its own row."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], keys), len(ids) - 1)
    hit = ids[order][at] == keys
    return order[at[hit]], np.flatnonzero(hit)


def _count(candidates: DataFrame, sent, dim: int, k: int) -> DataFrame:
    """Rows (q, bin, n): for each query a task's highest bins, until they hold k scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, low, width = sent.value
        counts = np.zeros((len(ids), BINS), np.int32)
        step = max(1, (1 << 21) // ROW_BLOCK)
        for keys, _, rows in _parts(batches, dim):
            mine, column = _own(ids, keys)
            for at in range(0, len(ids), step):
                s = products(vectors[at:at + step], rows)
                off = s - low[at:at + step, None]
                use = off >= 0
                here = (mine >= at) & (mine < at + step)
                use[mine[here] - at, column[here]] = False
                bins = np.minimum(off // width[at:at + step, None], BINS - 1)
                place = (np.arange(len(s)) * BINS)[:, None] + bins
                counts[at:at + step] += np.bincount(place[use], minlength=len(s) * BINS).reshape(len(s), BINS).astype(np.int32)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        for at in range(0, max(len(q), 1), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(q[part].astype(np.int32)), pa.array(b[part].astype(np.int32)), pa.array(counts[q[part], b[part]].astype(np.int64))], ["q", "bin", "n"])

    return candidates.mapInArrow(run, "q int, bin int, n bigint")


def _select(candidates: DataFrame, sent, dim: int, k: int) -> DataFrame:
    """Rows (row of the query, vec_id, score) from the k-th value up; of ties at it a task's k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, least = sent.value
        step = max(1, (1 << 21) // ROW_BLOCK)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, key, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((key, ~s, q))  # the negative of the least long is no long
            q, key, s = q[order], key[order], s[order]
            begin = np.searchsorted(q, q)
            keep = np.arange(len(q)) - begin < k
            return q[keep], key[keep], s[keep]

        for keys, names, rows in _parts(batches, dim):
            mine, column = _own(ids, keys)
            for at in range(0, len(ids), step):
                s = products(vectors[at:at + step], rows)
                use = s >= least[at:at + step, None]
                here = (mine >= at) & (mine < at + step)
                use[mine[here] - at, column[here]] = False
                q, c = np.nonzero(use)
                kept.append((q + at, names[c], s[q, c]))
                size += len(q)
                if size > 1 << 20:
                    kept = [cut()]
                    size = len(kept[0][0])
        if kept:
            q, key, s = cut()
            for at in range(0, len(q), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[part]]), pa.array(key[part]), pa.array(s[part])], ["row", "vec_id", "score"])

    return candidates.mapInArrow(run, "row bigint, vec_id bigint, score bigint")


def top(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of every row for which `queries` holds: query_id, rank, vec_id, score."""
    given = vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), finite(F.col(quoted(embedding))).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    kinds = given.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id", "v").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("copies"))
    # Of equal rows a query sees k others at most.
    shown = kinds.select("vec_id", "v", "asks", "copies", F.posexplode(F.sequence(F.lit(1), F.least("copies", F.lit(k + 1)))).alias("place", "n"))
    rows = saved(shown.select("vec_id", "v", (F.col("asks") & (F.col("place") == 0)).alias("asks"), "copies", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")))
    found = None
    sizes = rows.groupBy("dim").agg(F.count_if("asks").alias("q")).where("q > 0").orderBy("dim").toLocalIterator()
    for dim, asked in [(r.dim, r.q) for r in sizes]:
        own = rows.where(F.col("dim") == dim)
        blocks = -(-asked // block)
        for b in range(blocks):
            part = own.where(F.col("asks") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "v")
            table = part.orderBy("row").toArrow()
            if not table.num_rows:
                continue
            out = _block(own.select("row", "v", "vec_id"), table, dim, k)
            found = out if found is None else found.unionByName(out)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # Equal rows ask the same and are answered each.
    asked = rows.where("asks").select("row", F.col("vec_id").alias("query_id"), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("each"))
    return found.join(asked, "row").select("query_id", "rank", "vec_id", "score", F.explode("each")).drop("col")


def _block(candidates: DataFrame, asked: pa.Table, dim: int, k: int) -> DataFrame:
    context = candidates.sparkSession.sparkContext
    n = asked.num_rows
    ids = asked.column(0).to_numpy()
    vectors = matrix(asked.column(1).combine_chunks(), n) if dim else np.zeros((n, 0), np.int64)
    # By Cauchy and Schwarz no score is beyond the product of the norms.
    norm = candidates.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1)))).first()[0] or 0.0
    reach = np.minimum(np.ceil(np.sqrt((sizes(vectors) ** 2).sum(1)) * np.sqrt(norm) * 1.000001) + 1, 2.0 ** 61).astype(np.int64)
    low, span, above = -reach, 2 * reach + 1, np.zeros(n, np.int64)
    short = np.zeros(n, bool)
    while (span > 1).any():
        width = np.maximum(-(-span // BINS), 1)
        sent = context.broadcast((ids, vectors, low, width))
        rows = _count(candidates, sent, dim, k).groupBy("q", "bin").agg(F.sum("n").alias("n")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("bins"))
        # Of the merged bins: the one in which the running count from the top reaches k, or the lowest.
        step = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at")), lambda a, x: F.when((a["at"] >= 0) & (a["seen"] >= k), a).otherwise(
            F.struct((a["seen"] + x["n"]).alias("seen"), (-x["b"]).alias("at"))))
        at, reached = np.zeros(n, np.int64), np.zeros(n, bool)
        for r in rows.select("q", step.alias("s")).toLocalIterator():
            at[r.q], reached[r.q] = r.s.at, r.s.seen >= k
        short |= ~reached  # fewer than k candidates at all: every score counts
        low, span = np.where(short, low, low + at * width), np.where(short, 1, width)
        sent.unpersist()
    least = np.where(short, LONG[0], low)
    from pyspark.sql import Window

    rows = _select(candidates, context.broadcast((ids, vectors, least)), dim, k)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
