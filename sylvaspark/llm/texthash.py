"""Strong fingerprints of words and shingles, over blocks of texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased.  Its bytes are read
eight at a time, each eight are mixed into the state of two lanes with keys of their own, and
the length is mixed in last.  Every step is a bijection of the state that is not linear, so
texts built to collide under a rolling hash do not.  Very long words are digested by BLAKE2b.
Shingles are linear combinations of their words' fingerprints, mixed again; sums of 128 independent bits
stay 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_KEY = [U(0x243F6A8885A308D3), U(0x13198A2E03707344)]
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Bytes from which on a word is digested alone.
LONG = 512
#: Bytes of text hashed at once, about.
BLOCK = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def words(texts: list[bytes], lanes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """The lanes of all words of some texts, and where each text's words begin (len(texts) + 1 offsets)."""
    joined = b" ".join(texts).lower() + b" " * 9  # bytes: A-Z only
    block = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offset = np.concatenate([[0], np.cumsum(lengths)])
    inside = ~SPACE[block]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, size = edge[::2], edge[1::2] - edge[::2]
    eights = np.ndarray(len(block) - 7, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    state = [np.full(len(starts), k) for k in _KEY[:lanes]]
    open_, at = np.flatnonzero(size < LONG), 0
    while len(open_):
        left = size[open_] - at
        w = eights[starts[open_] + at] & _MASK[np.minimum(left, 8)]
        for lane, h in enumerate(state):
            if len(open_) == len(h):
                state[lane] = mix((h ^ w) + _KEY[lane])
            else:
                h[open_] = mix((h[open_] ^ w) + _KEY[lane])
        at += 8
        open_ = open_[left > 8]
    out = [mix(h + size.astype(np.uint64)) for h in state]
    for i in np.flatnonzero(size >= LONG):
        digest = np.frombuffer(blake2b(joined[starts[i] : starts[i] + size[i]], digest_size=16, key=b"words").digest(), np.uint64)
        for lane, h in enumerate(out):
            h[i] = digest[lane]
    return out, np.searchsorted(starts, offset)


_STEP = [
    [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F)],
    [U(x) for x in (0x9E3779B185EBCA87, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)],
]


def _windows(h: np.ndarray, lane: int, k: int) -> np.ndarray:
    s = h[: len(h) - k + 1] * _STEP[lane][0]
    for j in range(1, k):
        s = s + h[j : len(h) - k + 1 + j] * _STEP[lane][j]
    return mix(s + U(k))


def shingles(texts: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two lanes of each text's distinct k-word shingles, rising in the first; of all words if fewer."""
    lanes, at = words(texts)
    whole = [_windows(h, lane, k) if len(h) >= k else h[:0] for lane, h in enumerate(lanes)]
    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        n = last - first
        if n == 0:
            yield lanes[0][:0], lanes[1][:0]
            continue
        if n < k:
            yield tuple(_windows(h[first:last], lane, n) for lane, h in enumerate(lanes))
            continue
        a, b = whole[0][first : last - k + 1], whole[1][first : last - k + 1]
        order = np.argsort(a)
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
        if same.any():
            if (b[1:][same] != b[:-1][same]).any():  # one lane alone agrees
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            new = np.concatenate([[True], ~same])
            a, b = a[new], b[new]
        yield a, b
