"""Whole-text hashing with numpy: words, shingles and mixers, the same on every machine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Odd multipliers of the mixers and of the polynomials (any odd numbers do).
GOLD, MIX1, MIX2, BASE = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x5851F42D4C957F2D)
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: The first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Words of more bytes are hashed one by one.
_LONG = 4096
#: Texts are hashed together up to about so many bytes.
GROUP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def groups(texts: list[str], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together; a longer text is alone."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > most:
            yield at, i
            at, held = i, 0
        held += len(text)
    if len(texts) > at:
        yield at, len(texts)


def word_hashes(texts: list[str], beginnings: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and where each text's words begin (one more entry than texts).

    With ``beginnings`` (at most 8), of the first so many bytes of each longer word instead. Words are runs of ASCII letters and digits and of characters beyond ASCII. Eight bytes are
    taken at a time, so nearly all words need one or two steps.
    """
    parts = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=begin[1:])
    held = b"\n".join(parts) + b"\n" + bytes(8)
    data = np.frombuffer(held, np.uint8)
    inside = np.zeros(len(data) - 6, np.int8)
    inside[1:-1] = _IN_WORD[data[:-8]]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
    if beginnings:
        start = start[length > beginnings]
        return mix((eight[start] & _FIRST[beginnings]) ^ (GOLD >> U(beginnings))), np.searchsorted(start, begin)
    out = length.astype(U) * GOLD
    todo, done = np.flatnonzero(length <= _LONG), 0
    while len(todo):
        rest = length[todo] - done
        lane = eight[start[todo] + done] & _FIRST[np.minimum(rest, 8)]
        out[todo] = mix(out[todo] ^ lane)
        todo, done = todo[rest > 8], done + 8
    for i in np.flatnonzero(length > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(start, begin)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for each run of ``width`` words; a shorter text is one shingle, no words give none."""
    if not len(words):
        return words
    width, n = min(width, len(words)), max(1, len(words) - width + 1)
    total = np.zeros(n, U)
    for i in range(width):
        total = total * BASE + words[i : i + n]
    return mix(total + U(width * int(GOLD) % (1 << 64)))
