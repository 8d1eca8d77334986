"""The library's readers and functions under SQL names.

After ``register(spark)``::

    SELECT * FROM decode_tile(TABLE(SELECT log_url, n, width, skip, content FROM tiles))
    SELECT shown_domain(domain), fold_text(shown_domain(domain)) FROM names
    SELECT certificate_outline(der).not_after FROM entries
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType,
)

from .. import fixed_values as fv
from ..functions.der import LeafError, tile_records
from ..functions.der_columns import outline_udf
from ..functions.unicode import _ascii_udf, _fold_udf, _shown_udf

TILE_ENTRY = StructType([
    StructField("log_url", StringType()), StructField("index", LongType()), StructField("timestamp", LongType()),
    StructField("entry_type", IntegerType()), StructField("der", BinaryType()), StructField("chain_fps", ArrayType(StringType())),
    StructField("n", LongType()), StructField("error", StringType()),
])


class DecodeTile:
    """Rows (log_url, n, width, skip, content) to their entries, or to one row with ``error``; as ``entries.tile_rows``."""

    def eval(self, tile: Row) -> Iterator[tuple]:
        n, begin = tile["n"], tile["n"] * fv.TILE_WIDTH
        try:
            records, error = tile_records(bytes(tile["content"] or b"")), None
        except LeafError as err:
            records, error = [], str(err)
        first = records[0]["leaf_index"] if records else None
        if error is None and len(records) != tile["width"]:
            error = f"tile {n}: {len(records)} records instead of {tile['width']}"
        elif error is None and first is not None and first != begin:
            error = f"tile {n}: the first record is number {first}"
        if error is not None:
            yield tile["log_url"], None, None, None, None, None, n, error
            return
        for place, r in enumerate(records[tile["skip"]:], tile["skip"]):
            yield tile["log_url"], begin + place, r["timestamp"], r["entry_type"], r["der"], r["chain_fps"], n, None


def register(spark: SparkSession) -> None:
    """Make the table function and the functions known to the session's SQL."""
    spark.udtf.register("decode_tile", udtf(DecodeTile, returnType=TILE_ENTRY))
    for name, function in (("certificate_outline", outline_udf), ("shown_domain", _shown_udf), ("fold_text", _fold_udf), ("ascii_domain", _ascii_udf)):
        spark.udf.register(name, function)
