"""Joins that hold up when some keys own a large share of the rows.

Heavy keys are a table, however many there are; it has one row per key with more
than ``HEAVY_ROWS`` rows, and whether it is broadcast is left to the size checks of
the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capweave.operators.scratch import materialize

# A key is heavy above HEAVY_ROWS rows and gets one salt per HEAVY_ROWS.
HEAVY_ROWS = 1_000_000

# Key lists up to this many bytes are broadcast, longer ones are joined by shuffle.
MAX_BROADCAST_BYTES = 8 << 20

# Bits per wanted id in the map that thins out a wide table, and the most bits of a map (64 MB).
BITS_PER_ID = 16
MAX_BITS = 1 << 29

Heavy = DataFrame | None  # key and number of salts; None if no key is heavy


def heavy_keys(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> Heavy:
    """The keys with more than ``heavy_rows`` rows, from a scan of the key alone."""
    often = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > heavy_rows)
    if not often.limit(1).count():
        return None
    salts = F.floor(F.col("count") / max(heavy_rows, 1)).cast("int") + 1
    return materialize(often.select(key, salts.alias("_salts")), "heavy")


def spread_rows(df: DataFrame, key: str, heavy: Heavy, spread: str, name: str = "_salt") -> DataFrame:
    """Adds the salt of each row on the large side: by ``spread`` for heavy keys, 0 for others."""
    if heavy is None:
        return df.withColumn(name, F.lit(0))
    salt = F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")
    return df.join(heavy, key, "left").withColumn(name, F.coalesce(salt, F.lit(0))).drop("_salts")


def copy_rows(df: DataFrame, key: str, heavy: Heavy, name: str = "_salt") -> DataFrame:
    """Copies each row on the small side to every salt of its key; one copy for ordinary keys."""
    if heavy is None:
        return df.withColumn(name, F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return df.join(heavy, key, "left").withColumn(name, F.explode(salts)).drop("_salts")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    how: str = "left",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Equi-join of a large ``left`` with a ``right`` that has few rows per key.

    Rows of heavy keys on the left are spread by ``spread``, a column that
    differs between them, and the matching right rows are copied to each salt.
    The key of ``left`` is scanned twice, so ``left`` should be a table rather
    than the end of a long computation.  Whether a side is broadcast is left to the size checks of the planner.
    """
    heavy = heavy_keys(left, key, heavy_rows)
    if heavy is None:
        return left.join(right, key, how)
    return spread_rows(left, key, heavy, spread).join(copy_rows(right, key, heavy), [key, "_salt"], how).drop("_salt")


def pick(wide: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wide rows whose id is among the few that are wanted, as a semi join; ``wanted`` is written down first.

    A shuffle of all wide rows would move every body for the few that stay.  So the hashes of the wanted ids are set
    in a bit map, which is broadcast, and rows whose bit is not set are left out where they are read.  The join itself
    decides on the rest, so the map only has to be small, not exact: beyond MAX_BITS it lets more rows through.
    """
    # An inner join with distinct ids, as a semi join would be pushed below the join with the map.
    ids = materialize(wanted.select(key).distinct(), "wanted")
    bits = min(MAX_BITS, max(1 << 15, 1 << (ids.count() * BITS_PER_ID - 1).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = ids.groupBy(bit.bitwiseAND(F.lit(~0x7FFF)).alias("_map")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(0x7FFF))).alias("_bits")
    )
    at = bit.bitwiseAND(F.lit(0x7FFF)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    thinned = (
        wide.withColumn("_map", bit.bitwiseAND(F.lit(~0x7FFF)))
        .join(F.broadcast(maps), "_map")
        .filter(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1)
        .select(*wide.columns)
    )
    return thinned.join(ids, key).select(*wide.columns)


def key_join(left: DataFrame, keys: DataFrame, key: str, spread: str, how: str) -> DataFrame:
    """Semi or anti join with a list of keys that is short as a rule.

    Its bytes are counted: a short list is broadcast, which no hot key can
    unbalance, and a long one goes through :func:`skew_join`.
    """
    keys = keys.select(key).distinct()
    size = keys.agg(F.coalesce(F.sum(F.octet_length(key) + 16), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        return left.join(F.broadcast(keys), key, how)
    return skew_join(left, keys, key, spread, how)
