"""Two-bit draw status packed four to a byte, first slot in the low bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_PER_BYTE = 4


def byte_index(row_id: Column) -> Column:
    return F.floor(row_id / F.lit(SLOTS_PER_BYTE)).cast("bigint")


def shifted(status: Column, row_id: Column) -> Column:
    """Status moved to its slot, ready for a bitwise OR."""
    slot = F.pmod(row_id, F.lit(SLOTS_PER_BYTE)).cast("int")
    return status.cast("int") * F.element_at(
        F.array(*[F.lit(4**s) for s in range(SLOTS_PER_BYTE)]), slot + 1
    )


def unpack(packed: Column, slot: Column) -> Column:
    divisor = F.element_at(
        F.array(*[F.lit(4**s) for s in range(SLOTS_PER_BYTE)]), slot.cast("int") + 1
    )
    return F.pmod(F.floor(packed / divisor), F.lit(4)).cast("int")


def pack_status(status: DataFrame) -> DataFrame:
    """(draw_id, row_id, status) rows to (draw_id, byte_idx, packed)."""
    return (
        status.groupBy("draw_id", byte_index(F.col("row_id")).alias("byte_idx"))
        .agg(F.bit_or(shifted(F.col("status"), F.col("row_id"))).cast("int").alias("packed"))
    )


def unpack_status(packed: DataFrame, rows: int) -> DataFrame:
    """Inverse of :func:`pack_status`; trailing slots past ``rows`` are dropped."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS_PER_BYTE - 1)))
    return (
        packed.select("draw_id", "byte_idx", "packed", slots.alias("slot"))
        .select(
            "draw_id",
            (F.col("byte_idx") * SLOTS_PER_BYTE + F.col("slot")).alias("row_id"),
            unpack(F.col("packed"), F.col("slot")).alias("status"),
        )
        .where(F.col("row_id") < rows)
    )
