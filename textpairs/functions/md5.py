"""MD5 of many short byte strings at once, by array operations (a helper of the MinHash signatures)."""

from __future__ import annotations

import numpy as np

# fixed values: the shifts and constants of RFC 1321
_SHIFT = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, dtype=np.uint32)
_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint64).astype(np.uint32)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)
_ROWS = 8192  # strings that are hashed together: their arrays fit into a core's cache


def _digest(words: np.ndarray) -> list[np.ndarray]:
    """The four state words of padded messages; ``words`` is (16 x blocks, messages)."""
    state = [np.full(words.shape[1], s, dtype=np.uint32) for s in _START]
    f, t = np.empty_like(state[0]), np.empty_like(state[0])
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _ADD[i]
            f += words[block + _WORD[i]]
            np.right_shift(f, np.uint32(32) - _SHIFT[i], out=t)
            f <<= _SHIFT[i]
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        for s, x in zip(state, (a, b, c, d), strict=True):
            s += x
    return state


def prefixed_md5(data: np.ndarray, lengths: np.ndarray, prefixes: list[bytes]) -> list[np.ndarray]:
    """For every prefix (of 1 to 4 bytes, all equally long): (strings x 4), the digests of prefix + string as four big-endian
    numbers. The strings of ``lengths`` bytes stand one after the other in ``data``."""
    n, head = len(lengths), len(prefixes[0])
    starts = np.cumsum(lengths) - lengths
    out = [np.empty((n, 4), dtype=np.uint32) for _ in prefixes]
    blocks = (lengths + (head + 9 + 63)) // 64
    for k in np.unique(blocks):
        same = np.flatnonzero(blocks == k)
        step = max(1, _ROWS // int(k))
        for first in range(0, len(same), step):
            rows = same[first:first + step]
            size = lengths[rows]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            padded = np.zeros((len(rows), 64 * k), dtype=np.uint8)
            line = np.arange(len(rows)) * (64 * k) + head
            padded.ravel()[np.repeat(line, size) + at] = data[np.repeat(starts[rows], size) + at]
            padded.ravel()[line + size] = 0x80
            padded[:, -8:] = ((size + head) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
            words = np.ascontiguousarray(padded.view("<u4").T)
            plain = words[0].copy()
            for prefix, found in zip(prefixes, out, strict=True):
                words[0] = plain | np.uint32(int.from_bytes(prefix, "little"))
                found[rows] = np.stack(_digest(words), axis=1).byteswap()
    return out
