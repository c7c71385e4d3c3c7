"""Measured size limits for everything that is sent to all tasks, and the join for what exceeds them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 32 << 20  # as a hashed relation; the driver holds it up to three times: collected, hashed, in blocks
MAX_BROADCAST_ROWS = 1_000_000
ROW_BYTES = 128  # of a row of a hashed relation besides its payload: a copy of the key, headers, padding, its slot in the map
MAX_FEW_KEYS = 100_000
SALTS = 16


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int


def payload_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, nested values by that of their JSON, all else 8."""

    def width(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(column), F.lit(0))
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        return F.lit(8)

    return reduce(lambda a, b: a + b, map(width, df.schema.fields), F.lit(0)).cast("long")


def measure(df: DataFrame) -> Size:
    """Rows and payload bytes. Every task adds up its own rows, so one small row per task is shuffled."""
    row = df.select(payload_bytes(df).alias("bytes")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return Size(int(row["rows"]), int(row["bytes"]))


def relation_bytes(size: Size) -> int:
    """About what the rows take on the driver and in every executor when they are broadcast, more than their payload if they are short."""
    return size.bytes + ROW_BYTES * size.rows


def fits(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    size = measure(df)
    return size.rows <= max_rows and relation_bytes(size) <= max_bytes


def known_only(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` without rows whose keys ``right`` does not hold, where those keys were measured to be few; else ``left`` as it is.

    For a join that drops such rows anyway: they are then dropped before anything is shuffled or worked out of them.
    """
    own = right.select(keys).distinct()
    return left.join(F.broadcast(own), keys, "left_semi") if fits(own, max_rows=MAX_FEW_KEYS) else left


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], salt_by: Column, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join that spreads every key of ``left`` over ``salts`` partitions; ``right`` is repeated.

    ``right`` should be small per key (one row, or few): it is written ``salts`` times. Spark's own estimate knows nothing of
    rows that a generator or Python makes, so a side that was not measured to be small would be broadcast; the hint keeps it from that.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def sized_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    salt_by: Column | None = None,
    how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Broadcast ``right`` when it was measured to be small, else join salted. ``how``: inner, left, left_semi, left_anti.

    Without ``salt_by`` the keys of ``left`` hardly repeat, so nothing is salted.
    """
    if fits(right, max_bytes):
        return left.join(F.broadcast(right), keys, how)
    if salt_by is None:
        return left.join(right.hint("merge"), keys, how)
    return salted_join(left, right, keys, salt_by, how)
