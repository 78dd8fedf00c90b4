"""SHA-256 over many messages at once, with states that can be kept and resumed.

A message here is a row of digests as hex text: 64 bytes each, which is one block of the
hash, so the state between two digests is eight words and nothing is buffered. The
functions work on arrays of states (8 x n words) and of digests (n x 32 bytes).
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(n: int) -> int:
    root = int(round(n ** (1 / 3)))
    while root**3 > n:
        root -= 1
    while (root + 1) ** 3 <= n:
        root += 1
    return root


# Fractional parts of the square and cube roots of the first primes, 32 bits of each.
START = np.array([isqrt(p << 64) % (1 << 32) for p in _primes(8)], np.uint32)
ROUNDS = np.array([_cube_root(p << 96) % (1 << 32) for p in _primes(64)], np.uint32)

_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), "<u2")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n) after one more block of each message (16 x n)."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        if k >= 16:
            x, y = w[-15], w[-2]
            low = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
            high = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
            w = w[1:] + [w[0] + low + w[9] + high]
        word = w[k] if k < 16 else w[-1]
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[k] + word
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_text(digests: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) as hex text (n x 64 bytes)."""
    return _HEX[digests].view(np.uint8).reshape(len(digests), 64)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block (16 x n words) that each digest is as hex text."""
    return np.ascontiguousarray(hex_text(digests).view(">u4").T.astype(np.uint32))


def started(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def ended(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages that end after so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = blocks * 512
    return state_bytes(compress(state, last))


def state_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def bytes_state(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(raw).view(">u4").reshape(-1, 8).T.astype(np.uint32))
