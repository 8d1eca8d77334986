"""Where to read next: positions, lag, and read plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.render import tile_url


def latest_heads(heads: DataFrame) -> DataFrame:
    return heads.groupBy("log_url").agg(F.max_by("tree_size", "ts").alias("tree_size"))


def lag(heads: DataFrame, positions: DataFrame) -> DataFrame:
    """Latest tree size, next index and entries still to read, per log."""
    joined = latest_heads(heads).join(positions.select("log_url", "next_index"), "log_url", "left")
    return joined.withColumn("lag", F.col("tree_size") - F.col("next_index"))


def start_positions(lagging: DataFrame, backfill: int = 0, max_lag: int | None = None) -> DataFrame:
    """Where each log continues.

    A log without a position, or with one beyond its tree, starts ``backfill``
    entries before the tip. Nothing is skipped unless ``max_lag`` is given: then
    a log further behind jumps to the tip and counts what it skips.
    """
    size, saved = F.col("tree_size"), F.col("next_index")
    begin = F.when(saved.isNull() | (saved > size), F.greatest(F.lit(0), size - backfill)).otherwise(saved)
    moved = lagging.withColumn("_begin", begin).withColumn("_lag", size - F.col("_begin"))
    far = F.lit(False) if max_lag is None else F.col("_lag") > max_lag
    return moved.select(
        "log_url", "tree_size", F.when(far, size).otherwise(F.col("_begin")).alias("next_index"),
        F.when(far, F.col("_lag")).otherwise(0).alias("skipped"))


def _steps(first: Column, count: Column) -> Column:
    """``count`` numbers from ``first``, none when count is 0."""
    return F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(F.array().cast("array<bigint>"))


def plan_tiles(positions: DataFrame, include_partial: Column | bool = False) -> DataFrame:
    """Data tiles to read: every full tile, and the partial tail when asked.

    ``skip`` is the number of leading records before the next index.
    """
    wide = F.lit(fv.TILE_WIDTH).cast("bigint")
    partial = F.lit(include_partial) if isinstance(include_partial, bool) else include_partial
    full, tail = F.floor(F.col("tree_size") / wide), F.col("tree_size") % wide
    begin = F.floor(F.col("next_index") / wide)
    rows = positions.filter("tree_size > next_index").withColumns({
        "_full": full, "_tail": tail, "_want": F.coalesce(partial, F.lit(False)) & (tail > 0)})
    count = F.greatest(F.col("_full") - begin, F.lit(0)) + F.when(
        F.col("_want") & (F.col("next_index") < F.col("_full") * wide + F.col("_tail")), 1).otherwise(0)
    tiles = rows.withColumn("n", F.explode(_steps(F.least(begin, F.col("_full")), count)))
    width = F.when(F.col("n") < F.col("_full"), wide).otherwise(F.col("_tail"))
    return tiles.select(
        "log_url", "n", width.cast("int").alias("width"),
        F.greatest(F.lit(0), F.col("next_index") - F.col("n") * wide).cast("int").alias("skip")).withColumn(
        "url", tile_url(F.col("log_url"), F.col("n"), F.col("width")))


def partial_due(heads: DataFrame, wait: str = "15 seconds") -> DataFrame:
    """Whether a log's partial tail tile has stayed the tail long enough."""
    wide = fv.TILE_WIDTH
    seen = heads.select("log_url", "ts", "tree_size", F.floor(F.col("tree_size") / wide).alias("tile"))
    spans = seen.filter(F.col("tree_size") % wide > 0).groupBy("log_url", "tile").agg(F.min("ts").alias("since"))
    last = seen.groupBy("log_url").agg(F.max_by(F.struct("tile", "tree_size"), "ts").alias("l"), F.max("ts").alias("now")).select(
        "log_url", "now", F.col("l.tile").alias("tile"), F.col("l.tree_size").alias("tree_size"))
    waited = F.coalesce(F.col("now") >= F.col("since") + F.expr(f"interval {wait}"), F.lit(False))
    return last.join(spans, ["log_url", "tile"], "left").select(
        "log_url", "tile", ((F.col("tree_size") % wide > 0) & waited).alias("due"))


def plan_pages(positions: DataFrame, page: int = 256, in_flight: int = 4) -> DataFrame:
    """Page-aligned [start, end] requests, at most ``in_flight`` per log."""
    first = F.floor(F.col("next_index") / page)
    pages = F.least(F.floor((F.col("tree_size") - 1) / page) - first + 1, F.lit(in_flight))
    rows = positions.filter("next_index < tree_size").withColumn("_p", F.explode(_steps(first, pages)))
    return rows.select(
        "log_url", F.greatest(F.col("next_index"), F.col("_p") * page).alias("start"),
        F.least((F.col("_p") + 1) * page, F.col("tree_size")).alias("_stop")).select(
        "log_url", "start", (F.col("_stop") - 1).alias("end"))


def declared_jumps(started: DataFrame) -> DataFrame:
    """The stretches that ``start_positions`` jumped over: log_url, from, to (exclusive)."""
    return started.filter("skipped > 0").select("log_url", (F.col("next_index") - F.col("skipped")).alias("from"), F.col("next_index").alias("to"))


def positions(entries: DataFrame, rejected: DataFrame | None = None, jumps: DataFrame | None = None) -> DataFrame:
    """The next index to read per log: where what was read without a gap ends.

    What was read is a union of ranges: tile-wide stretches of which an entry was read, and
    ``jumps`` (log_url, from, to), which were passed over on purpose. A tile of ``rejected`` (log_url, n)
    is read up to the last entry that there is of it, so one that was accepted in another attempt is
    no gap. The first gap is the least end of a range at which no other goes on; ends
    and beginnings meet in joins, and no log's ranges meet in one place.
    """
    wide = fv.TILE_WIDTH
    tiles = entries.groupBy("log_url", F.floor(F.col("index") / wide).alias("n")).agg((F.max("index") + 1).alias("upto"))
    begin, end = F.col("n") * wide, (F.col("n") + 1) * wide
    if rejected is None:
        ranges = tiles.select("log_url", "n", "upto", F.lit(False).alias("_cut"))
    else:
        bad = rejected.select("log_url", F.col("n").cast("bigint").alias("n")).distinct().withColumn("_bad", F.lit(True))
        both = tiles.join(bad, ["log_url", "n"], "full")
        cut = F.col("_bad").isNotNull() & (F.coalesce("upto", begin) < end)
        ranges = both.select("log_url", "n", "upto", cut.alias("_cut"))
    # Where each range ends; one that was cut goes no further than its last entry.
    ranges = ranges.withColumn("end", F.when(F.col("_cut"), F.coalesce("upto", begin)).otherwise(end))
    following = ranges.filter("upto IS NOT NULL OR NOT _cut").select("log_url", (F.col("n") * wide).alias("end"))
    open_ = ranges.filter("_cut").select("log_url", "end").unionByName(ranges.filter("NOT _cut").select("log_url", "end").join(following, ["log_url", "end"], "left_anti"))
    last = ranges.groupBy("log_url").agg(F.max("upto").alias("last"))
    if jumps is not None:
        leaps = jumps.select("log_url", F.col("from").alias("_from"), F.col("to").alias("_to")).filter("_from < _to").distinct()
        # A leap leads on where a range that was read, or another leap, holds its end.
        held = ranges.select("log_url", F.col("n").alias("_n"), F.col("end").alias("_end"))
        reached = leaps.withColumn("_n", F.floor(F.col("_to") / wide)).join(held, ["log_url", "_n"], "left")
        ends = open_.unionByName(reached.filter("_end IS NULL OR _to >= _end").select("log_url", F.col("_to").alias("end")))
        over = (ends["log_url"] == leaps["log_url"]) & (F.col("_from") <= F.col("end")) & (F.col("end") < F.col("_to"))
        open_ = ends.join(leaps, over, "left_anti")
        last = last.join(leaps.groupBy("log_url").agg(F.max("_to").alias("_leapt")), "log_url", "full").select("log_url", F.greatest("last", "_leapt").alias("last"))
    first = open_.groupBy("log_url").agg(F.min("end").alias("gap"))
    return last.join(first, "log_url", "full").select("log_url", F.least("last", "gap").alias("next_index"))
