"""Separating the rows whose key is unique from those whose key may repeat, without moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 26  # bits of the filter: 2,048 bitmaps of 4 KB, so at most 8 MB are broadcast, whatever the table's size


def by_repetition(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key certainly occurs once, the others). NULL keys drop out.

    Only 64-bit hashes of the keys are shuffled. The hashes that occur more than once are marked in a bitmap of SLOTS bits, which is
    broadcast; a unique key that shares its bit with a repeated one goes with the others, so whoever deduplicates those by the key gets an
    exact result. Removing a few repeated rows thus costs no shuffle of wide columns; where most keys repeat, the second part is most of the table.
    """
    rows = rows.where(F.col(key).isNotNull())
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    again = rows.select(F.xxhash64(key).alias("_h")).groupBy("_h").count().where("count > 1").select(F.pmod("_h", F.lit(SLOTS)).alias("_s"))
    maps = again.groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_map"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("_bucket"), "left")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.where(~hit).select(rows.columns), marked.where(hit).select(rows.columns)
