"""Bit arithmetic: column expressions, and numpy kernels for packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _half() -> Column:
    return F.expr(f"cast('{1 << 63}' AS decimal(20,0))")


def signed(x: Column) -> Column:
    """An unsigned 64-bit number (DECIMAL) less 2**63: a LONG in the same order."""
    return (x.cast("decimal(20,0)") - _half()).cast("long")


def unsigned(x: Column) -> Column:
    """The number that signed() made a LONG of."""
    return (x.cast("decimal(20,0)") + _half()).cast("decimal(20,0)")


def wrapped(x: Column) -> Column:
    """A whole number (DECIMAL) modulo 2**64 as a LONG."""
    turn = F.expr(f"cast('{1 << 64}' AS decimal(21,0))")
    x = F.pmod(x.cast("decimal(38,0)"), turn)
    return F.when(x >= _half(), x - turn).otherwise(x).cast("long")


def minus(a: Column, b: Column) -> Column:
    """a - b modulo 2**64, of LONGs."""
    return F.coalesce(F.try_subtract(a, b), wrapped(a.cast("decimal(20,0)") - b.cast("decimal(20,0)")))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2 … to 0, 1, 2, 3 …; codes from 2**63 on are the LONGs with the same bits."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(code: Column) -> Column:
    return F.shiftrightunsigned(code, 1).bitwiseXOR(-code.bitwiseAND(F.lit(1).cast("long")))


def bit_width(x: Column) -> Column:
    """Bits of an unsigned number, given as the LONG with the same bits; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def byte_length(x: Column) -> Column:
    """Bytes of a number from 0 up; 0 for 0."""
    return F.floor((bit_width(x) + 7) / 8).cast("int")


def byte_key(x: Column) -> Column:
    """The first 8 bytes, zero-padded, as an unsigned big-endian number (DECIMAL(20,0))."""
    eight = F.rpad(F.substring(x.cast("binary"), 1, 8), 8, F.lit(b"\x00"))
    return F.conv(F.hex(eight), 16, 10).cast("decimal(20,0)")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits (0 to 64) one behind another, lowest bit first."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: n * width].reshape(n, width)
    whole = np.zeros((n, 64), dtype=np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel()
