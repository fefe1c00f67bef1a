"""CRC-32C (Castagnoli) of many byte ranges at once in numpy, and its masked form.

A CRC without its first and last inversion is linear, and zeros in front do not change it. So the ranges are padded in front to whole
blocks, each block is looked up byte by byte in parallel, and neighbouring blocks are joined in a tree: the left one is
moved past the right one's bytes by table and added.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
MASK_ADD = 0xA282EAD8
BLOCK = 64


def _byte_step(state: np.ndarray) -> np.ndarray:
    """The state after one zero byte."""
    for _ in range(8):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (tables[0][state & 255] ^ tables[1][(state >> 8) & 255]
            ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24])


def _tables(step) -> np.ndarray:
    """A linear map of states as four tables by byte."""
    return np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])


_moves = [_tables(_byte_step)]  # past 2**k zero bytes


def _past(power: int) -> np.ndarray:
    while len(_moves) <= power:
        last = _moves[-1]
        _moves.append(_tables(lambda s: _apply(last, _apply(last, s))))
    return _moves[power]


_columns = [np.zeros(0)]


def _column_tables() -> np.ndarray:
    """What a byte adds to the state of its block, by its place in the block."""
    if len(_columns) == 1:
        rows = [_byte_step(np.arange(256, dtype=np.uint32))]
        for _ in range(BLOCK - 1):
            rows.append(_byte_step(rows[-1]))
        _columns.append(np.stack(rows[::-1]))
    return _columns[1]


def crc32c(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The CRC-32C of ``data[bounds[i]:bounds[i + 1]]`` for each i."""
    length = np.diff(bounds)
    n = len(length)
    blocks = -(-length // BLOCK)
    last = np.cumsum(blocks)
    padded = np.zeros((int(last[-1]) if n else 0, BLOCK), dtype=np.uint8)
    shift = last * BLOCK - bounds[1:]
    padded.ravel()[np.arange(bounds[0], bounds[-1]) + np.repeat(shift, length)] = data[bounds[0]:bounds[-1]]
    tables = _column_tables()
    state = np.zeros(len(padded), dtype=np.uint32)
    for column in range(BLOCK):
        state ^= tables[column][padded[:, column]]
    power = BLOCK.bit_length() - 1
    while n and blocks.max() > 1:
        # from the end of each range, pairs of neighbours become one; an odd first block stays as it is
        first = np.cumsum(blocks) - blocks
        from_end = np.repeat(first + blocks - 1, blocks) - np.arange(len(state))
        left = from_end % 2 == 1
        state[np.flatnonzero(left) + 1] ^= _apply(_past(power), state[left])
        odd = (blocks % 2 == 1) & (blocks > 0)
        state = state[~left]
        blocks = blocks // 2 + odd
        power += 1
    out = np.zeros(n, dtype=np.uint32)
    out[blocks > 0] = state
    start = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for bit in range(int(length.max()).bit_length() if n else 0):
        has = (length >> bit) & 1 == 1
        start[has] = _apply(_past(bit), start[has])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Turned right by 15 bits plus a constant, so that a CRC stored with its data does not confuse another CRC over both."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_ADD)
