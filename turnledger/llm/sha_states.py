"""SHA-256 as states that can be stored: many messages at once, block by block.

A state is eight words after any number of whole 64-byte blocks. ``hashlib`` keeps its state
to itself; here it is data, so that a job can write it to a table and go on from it in
another task. A digest in hex is exactly one block, which is all that a tree of hex digests
ever appends. Arrays are (words, messages), so that each step runs over contiguous memory.
"""

from __future__ import annotations

import numpy as np

WORDS = 8  # of a state
BLOCK = 16  # words of a block, a digest in hex


def _root_bits(prime: int, power: int) -> int:
    """The first 32 bits of the fractional part of the square or cube root of a prime."""
    target, root = prime << (32 * power), 0
    for bit in range(40, -1, -1):
        if (root | 1 << bit) ** power <= target:
            root |= 1 << bit
    return root & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, int(p**0.5) + 1))]
_K = np.array([_root_bits(p, 3) for p in _PRIMES], np.uint32)
_START = np.array([_root_bits(p, 2) for p in _PRIMES[:WORDS]], np.uint32)
_HEX = np.frombuffer(bytes.fromhex("".join(f"{x:02x}".encode().hex() for x in range(256))), np.uint16)
_CHUNK = 4096  # messages at once: the working set then stays in the cache


def start(n: int) -> np.ndarray:
    return np.repeat(_START[:, None], n, axis=1)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= BLOCK:
            x, y = w[(i - 15) % BLOCK], w[(i - 2) % BLOCK]
            low = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            high = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w[i % BLOCK] = w[i % BLOCK] + low + w[(i - 7) % BLOCK] + high
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _K[i] + w[i % BLOCK]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block."""
    if state.shape[1] <= _CHUNK:
        return _absorb(state, block)
    out = np.empty_like(state)
    for at in range(0, state.shape[1], _CHUNK):
        out[:, at : at + _CHUNK] = _absorb(state[:, at : at + _CHUNK], block[:, at : at + _CHUNK])
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests, as words, of messages of so many whole blocks."""
    end = np.zeros((BLOCK, state.shape[1]), np.uint32)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    end[0] = 0x80000000
    end[14], end[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, end)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digest words as the block of their hex text: (8, n) to (16, n)."""
    text = _HEX[np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)]
    return np.ascontiguousarray(text.view(">u4").T.astype(np.uint32))


def words(raw: np.ndarray) -> np.ndarray:
    """Words of rows of bytes: (n, 4 * words) to (words, n)."""
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").T.astype(np.uint32))


def raw(state: np.ndarray) -> np.ndarray:
    """Rows of bytes of words: (words, n) to (n, 4 * words)."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8)
