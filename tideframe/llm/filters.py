"""Counting quotient filters that lose nothing: whole keys of up to 64 bits in little space, merged as sorted runs.

A key is permuted by an invertible map of its bits and cut into a quotient (upper bits) and a remainder
(the rest, kept whole).  A filter holds its keys in ascending order: of each quotient the length of its
run in unary, of each key the remainder, and the counters as compressed planes of bytes.  The
permutation spreads the keys evenly, so equal ranges of quotients are equal shares of the keys, and
inverting it gives the keys back.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

HEAD = "<qBB"
#: Odd multipliers of the permutation.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Permutation:
    """An invertible map of the numbers below 2 ** bits: multiplications by odd numbers and folds of the upper half."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 64:
            raise ValueError(f"keys of {bits} bits don't fit in 64")
        self.bits, self.mask, self.half = bits, np.uint64(2**bits - 1), np.uint64((bits + 1) // 2)

    def mix(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        for m in MULTIPLIERS:
            keys = keys * np.uint64(m) & self.mask
            keys ^= keys >> self.half
        return keys

    def unmix(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        for m in reversed(MULTIPLIERS):
            keys = keys ^ keys >> self.half  # folds at most half of the bits, so twice is the identity
            keys = keys * np.uint64(pow(m, -1, 2**64)) & self.mask
        return keys


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative numbers: their bytes in planes of equal weight, as many as the largest needs, compressed."""
    n = len(numbers)
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width].T
    return struct.pack("<qB", n, width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qB", data)
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").reshape(n)


def pack(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """Filter of ascending distinct permuted keys below 2 ** bits."""
    n = len(keys)
    whole = -(-max(bits - n.bit_length(), 0) // 8)  # bytes of a remainder; about one quotient per key
    low = min(8 * whole, bits)
    quotient = (keys >> np.uint64(low) if low < 64 else np.zeros(n, np.uint64)).astype(np.int64)
    runs = np.zeros(n + (1 << (bits - low)), dtype=np.uint8)
    runs[quotient + np.arange(n)] = 1
    remainders = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :whole]
    return struct.pack(HEAD, n, bits, whole) + np.packbits(runs).tobytes() + remainders.tobytes() + pack_numbers(counts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(permuted keys, counts) of a filter."""
    n, bits, whole = struct.unpack_from(HEAD, data)
    low, at = min(8 * whole, bits), struct.calcsize(HEAD)
    size = n + (1 << (bits - low))
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size))
    at += -(-size // 8)
    remainders = np.zeros((n, 8), dtype=np.uint8)
    remainders[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    keys = remainders.view("<u8").reshape(n).astype(np.uint64)
    if low < 64:
        # the remainder's last byte may reach above ``low`` only where the quotient is empty
        keys |= (ones - np.arange(n)).astype(np.uint64) << np.uint64(low)
    return keys, unpack_numbers(data[at + n * whole :])


def merge(runs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct keys of ascending runs, place of each run's keys among them); the stable sort merges the runs."""
    keys = np.concatenate([*runs, np.zeros(0, np.uint64)])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], np.split(place, np.cumsum([len(r) for r in runs])[:-1]) if runs else []


def slices(keys: np.ndarray, counts: np.ndarray, bits: int, slice_bits: int) -> list[tuple[int, bytes]]:
    """Filters of ascending permuted keys by their upper ``slice_bits``, which the filters leave out."""
    low = bits - slice_bits
    part = (keys >> np.uint64(low) if low < 64 else np.zeros(len(keys), np.uint64)).astype(np.int64)
    own = keys & np.uint64(2**low - 1)
    found, starts = np.unique(part, return_index=True)
    return [(int(k), pack(own[lo:hi], counts[lo:hi], low)) for k, lo, hi in zip(found, starts, [*starts[1:], len(keys)])]


def whole_keys(slice_number: int, keys: np.ndarray, bits: int, slice_bits: int) -> np.ndarray:
    """Permuted keys of a slice with their upper bits."""
    low = bits - slice_bits
    return keys | np.uint64(slice_number << low) if slice_bits else keys


def slice_bits_for(entries: int, bits: int, per_slice: int = 1 << 20) -> int:
    """Upper bits that cut ``entries`` permuted keys into slices of about ``per_slice``."""
    return min(max(-(-entries // per_slice) - 1, 0).bit_length(), max(bits - 1, 0))
