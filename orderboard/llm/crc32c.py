"""CRC-32C (Castagnoli) of many byte strings at once, and the mask of record files.

A CRC is linear: the state after a string is the exclusive or of what its parts
contribute, each moved on by the bytes behind it. So strings are cut into lanes
of 64 bytes, all lanes are run side by side, and a record's lanes are moved into
place and joined. Zeros in front of a string change nothing, which pads lanes.
"""

from __future__ import annotations

import numpy as np

# The reflected polynomial and the mask's constant.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

LANE = 64


def _zero_byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


_BYTE = _zero_byte_table()


def _moved(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (
        tables[0][state & 255]
        ^ tables[1][(state >> 8) & 255]
        ^ tables[2][(state >> 16) & 255]
        ^ tables[3][state >> 24]
    )


def _power_tables(powers: int) -> list[np.ndarray]:
    """For each j, what 2**j zero bytes make of each byte of a state."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << (8 * k) for k in range(4)])
    tables = [_BYTE[one & 255] ^ (one >> 8)]
    for _ in range(powers - 1):
        tables.append(_moved(tables[-1], tables[-1]))
    return tables


_POWERS = _power_tables(40)


def _moved_by(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each state after its number of zero bytes."""
    state = state.copy()
    for j in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> j) & 1)
        state[at] = _moved(_POWERS[j], state[at])
    return state


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string, as uint32."""
    if not strings:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(s) for s in strings], np.int64)
    lanes = np.maximum(1, -(-sizes // LANE))
    padded = b"".join(
        bytes(int(n) * LANE - len(s)) + s for s, n in zip(strings, lanes, strict=True)
    )
    data = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(-1, LANE).T)
    state = np.zeros(len(padded) // LANE, np.uint32)
    for byte in data:
        state = _BYTE[(state ^ byte) & 255] ^ (state >> 8)
    starts = np.cumsum(lanes) - lanes
    behind = np.repeat(starts + lanes, lanes) - np.arange(len(state)) - 1
    joined = np.bitwise_xor.reduceat(_moved_by(state, behind * LANE), starts)
    first = _moved_by(np.full(len(strings), 0xFFFFFFFF, np.uint32), sizes)
    return joined ^ first ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The checksum as it is stored: rotated right by 15 bits, plus a constant."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
