"""SHA-256 of many messages at once, with states that can be kept, copied and taken up again.

The messages are the children of tree nodes: each child is a digest as hexadecimal text, 64 bytes and so exactly one block
of the hash. The state before a child is therefore eight 32-bit numbers, nothing is buffered, and it can be stored as 32 bytes,
which the hash objects of the standard library do not allow.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

#: Children of a node.
FAN = 16
DIGEST = 32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


# The constants of the standard: fractions of square and cube roots of the first primes.
_START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
_ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 rows) after one more block (16 rows) for every column."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t, constant in enumerate(_ROUNDS):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = (
                w[t % 16]
                + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                + w[(t - 7) % 16]
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
            )
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + constant + w[t % 16]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def start(n: int) -> np.ndarray:
    """The state before the first child, for ``n`` messages."""
    return np.repeat(_START[:, None], n, axis=1)


def block_of(digests: np.ndarray) -> np.ndarray:
    """Digests (rows of 32 bytes) as blocks of hexadecimal text (columns of 16 numbers)."""
    text = np.empty((len(digests), 2 * DIGEST), dtype=np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests (rows of 32 bytes) of messages that end here, after so many children."""
    last = np.zeros((16, state.shape[1]), dtype=np.uint32)
    last[0], last[15] = 0x80000000, children.astype(np.uint32) * np.uint32(8 * 2 * DIGEST)
    return as_bytes(absorb(state, last))


def as_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, DIGEST)


def as_state(kept: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(kept).view(">u4").astype(np.uint32).reshape(-1, 8).T


def hash_children(digests: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with ``counts`` children each, whose digests follow one another: the digest of each node, and the state before each child."""
    first = np.cumsum(counts) - counts
    state, kept = start(len(counts)), np.empty_like(digests)
    for slot in range(int(counts.max(initial=0))):
        on = np.flatnonzero(counts > slot)
        kept[first[on] + slot] = as_bytes(state[:, on])
        state[:, on] = absorb(state[:, on], block_of(digests[first[on] + slot]))
    return finish(state, counts), kept


def resume(kept: np.ndarray, replacement: np.ndarray, children: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The digests of nodes with one child replaced.

    ``kept``: the state before the slot; ``children``: the ``FAN`` places of each node, of which only those right of the slot are read.
    """
    state = absorb(as_state(kept), block_of(replacement))
    for step in range(1, FAN):
        on = np.flatnonzero(slots + step < counts)
        if len(on) == 0:
            break
        state[:, on] = absorb(state[:, on], block_of(children[on, slots[on] + step]))
    return finish(state, counts)
