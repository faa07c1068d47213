"""A semi-join filter of fixed size, to drop rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh, quoted

#: Buckets of 32,768 bits; the filter is broadcast, and takes 4 KB for each bucket that has a key, whatever the number
#: of keys.
BUCKETS = 1024


def _spot(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(buckets * 32768))


def bitmaps(listed: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(place, bitmap): the filter of the keys in ``listed``, ``buckets`` rows of 4 KB at most."""
    spot = _spot(keys, buckets)
    bits = listed.select(F.bitmap_bucket_number(spot).alias("place"), F.bitmap_bit_position(spot).alias("bit"))
    return bits.groupBy("place").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merged(filters: DataFrame) -> DataFrame:
    """One filter for all keys of several."""
    return filters.groupBy("place").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def marked(rows: DataFrame, filter_: DataFrame, keys: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows with a boolean ``name``: whether their keys can be among those of the filter."""
    spot = _spot(keys, buckets)
    place, bitmap = fresh([*rows.columns, name], "place"), fresh([*rows.columns, name], "bitmap")
    named = filter_.select(F.col("place").alias(place), F.col("bitmap").alias(bitmap))
    bit = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(quoted(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(named), F.bitmap_bucket_number(spot) == F.col(quoted(place)), "left")
    return joined.select(*map(quoted, rows.columns), maybe.alias(name))


def only_marked(rows: DataFrame, filter_: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose keys can be among those of the filter."""
    name = fresh(rows.columns, "maybe")
    return marked(rows, filter_, keys, name, buckets).where(quoted(name)).drop(name)


def only_listed(rows: DataFrame, listed: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose ``keys`` are in ``listed``, and by chance some others; a join on the keys has to follow. Many keys
    let more others through.
    """
    return only_marked(rows, bitmaps(listed, keys, buckets), keys, buckets)


def drop_listed(rows: DataFrame, listed: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows whose ``keys`` are not in ``listed``, exactly; null keys are never listed. Only rows that can be listed
    are shuffled.
    """
    name = fresh(rows.columns, "maybe")
    both = marked(rows, bitmaps(listed, keys, buckets), keys, name, buckets)
    certain, maybe = both.where(~F.col(quoted(name))).drop(name), both.where(quoted(name)).drop(name)
    return certain.unionByName(maybe.join(listed.select(*map(quoted, keys)), keys, "left_anti"))
