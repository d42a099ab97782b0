"""BLAKE3 over many values at once: the words of all of them side by side in numpy arrays."""

from __future__ import annotations

import numpy as np

from .crypto import _CHUNK_END, _CHUNK_START, _IV, _PARENT, _PERMUTATION, _ROOT

CHUNK, BLOCK = 1024, 64
_G = [(k, 4 + k, 8 + k, 12 + k) for k in range(4)] + [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]


def compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(n, 16) words of n compressions; arguments are (n, 8), (n, 16) and three of n."""
    n = len(cv)
    v = np.empty((16, n), np.uint32)
    v[:8] = cv.T
    v[8:12] = np.array(_IV[:4], np.uint32)[:, None]
    v[12], v[13], v[14], v[15] = counter & 0xFFFFFFFF, counter >> 32, length, flags
    m = np.ascontiguousarray(block.T)
    for round_ in range(7):
        for k, (a, b, c, d) in enumerate(_G):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] += v[b] + word
                t = v[d] ^ v[a]
                v[d] = t >> np.uint32(r1) | t << np.uint32(32 - r1)
                v[c] += v[d]
                t = v[b] ^ v[c]
                v[b] = t >> np.uint32(r2) | t << np.uint32(32 - r2)
        if round_ < 6:
            m = m[list(_PERMUTATION)]
    return np.concatenate([v[:8] ^ v[8:], v[8:] ^ cv.T]).T


def chunk_words(chunks: list[bytes], counters: np.ndarray, root: np.ndarray) -> np.ndarray:
    """(n, 16) words of chunks of 1,024 bytes at most; the first eight are the chaining value, all of them the digest where ``root``."""
    lengths = np.array([len(c) for c in chunks], np.int64)
    most = max(1, -(-int(lengths.max(initial=0)) // BLOCK))
    data = np.frombuffer(b"".join(c.ljust(most * BLOCK, b"\0") for c in chunks), "<u4").reshape(len(chunks), most, 16)
    cv = np.tile(np.array(_IV, np.uint32), (len(chunks), 1))
    out = np.zeros((len(chunks), 16), np.uint32)
    last = np.maximum(1, -(-lengths // BLOCK)) - 1
    counters = np.asarray(counters, np.int64)
    for k in range(most):
        on = np.flatnonzero(last >= k)
        ends = last[on] == k
        flags = _CHUNK_START * (k == 0) + ends * (_CHUNK_END + _ROOT * root[on])
        words = compress(cv[on], data[on, k], counters[on], np.minimum(BLOCK, lengths[on] - k * BLOCK), flags)
        out[on[ends]] = words[ends]
        cv[on] = words[:, :8]
    return out


def fold(cvs: np.ndarray, owner: np.ndarray, root: np.ndarray) -> np.ndarray:
    """(m, 16) words: for each of m owners its chaining values, in order, paired level by level until one is left; an odd one goes up as it is.

    Where ``root``, the last pair gives the digest. An owner of one value has it in the first eight words.
    """
    m = len(root)
    words = np.zeros((len(cvs), 16), np.uint32)
    words[:, :8] = cvs
    while len(words) > m:
        count = np.bincount(owner, minlength=m)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        at = np.arange(len(words)) - start[owner]
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < count[owner]))
        flags = _PARENT + _ROOT * (root[owner[left]] & (count[owner[left]] == 2))
        zero = np.zeros(len(left), np.int64)
        made = compress(np.tile(np.array(_IV, np.uint32), (len(left), 1)), np.concatenate([words[left, :8], words[left + 1, :8]], axis=1), zero, zero + BLOCK, flags)
        stays = at % 2 == 0
        words[left] = made
        words, owner = words[stays], owner[stays]
    return words


def digests(values: list[bytes]) -> list[bytes]:
    """64-byte digests of whole values."""
    if not values:
        return []
    count = np.array([max(1, -(-len(v) // CHUNK)) for v in values], np.int64)
    owner = np.repeat(np.arange(len(values)), count)
    counters = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)[:-1]])[owner]
    chunks = [v[i : i + CHUNK] for v in values for i in range(0, max(1, len(v)), CHUNK)]
    words = chunk_words(chunks, counters, count[owner] == 1)
    many = count > 1
    out = np.zeros((len(values), 16), np.uint32)
    out[~many] = words[count[owner] == 1]
    if many.any():
        on = many[owner]
        number = np.cumsum(many) - 1
        out[many] = fold(words[on, :8], number[owner[on]], np.ones(int(many.sum()), bool))
    return [w.astype("<u4").tobytes() for w in out]
