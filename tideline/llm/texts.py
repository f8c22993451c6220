"""Text primitives shared by the operators: words, folds, SimHash bit counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space characters; the same
#: split as ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def lane_table() -> np.ndarray:
    """For each byte value a 64-bit word that holds its eight bits in eight bytes."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set.

    The bits of a hash are added as eight packed byte counters, 255 hashes at a
    time, so a count never overflows its byte.
    """
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes[part], np.arange(0, len(part), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray, lanes: np.ndarray) -> int:
    """The SimHash of unsigned 64-bit hashes as a signed long: bits set in over half."""
    if not len(hashes):
        return 0
    over = bit_counts(hashes, lanes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])
