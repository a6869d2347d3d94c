"""Hashing the words, prefixes and shingles of many texts at once with numpy.

Texts come as UTF-8 bytes. A table maps each byte to a space (a separator) or to the byte that counts, so lower-casing
A-Z and splitting take one `bytes.translate`. Word hashes come from prefix sums of byte codes times powers of an odd
multiplier modulo 2**64, so no word becomes a Python object. Memory is bounded by the hashes of one text plus a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 19
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64) | _U(1)


def _table(is_word) -> bytes:
    lower = lambda b: b + 32 if 65 <= b <= 90 else b
    return bytes(lower(b) if is_word(b) else 32 for b in range(256))


#: Words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are runs of ASCII letters, digits and anything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _POW_INV = _powers(_MUL, 4 * CHUNK), _powers(_INV, 4 * CHUNK)


def _pieces(texts: Sequence[bytes | None], table: bytes) -> Iterator[tuple[int, bytes]]:
    """(index, part) with parts cut at separators where a text is longer than a chunk."""
    for i, text in enumerate(texts):
        if text is None:
            continue
        text = bytes(text).translate(table)
        at = 0
        while len(text) - at > 2 * CHUNK and (end := text.find(b" ", at + CHUNK)) > 0:
            yield i, text[at:end]
            at = end
        yield i, text[at:]


def hashed(texts: Sequence[bytes | None], table: bytes, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(hash of each word, for each length in `prefixes` the hash of each word's first bytes or 0 where it is no longer, words in each text)."""
    counts = np.zeros(len(texts), np.int64)
    whole: list[np.ndarray] = []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        buf = np.frombuffer(b" " + b" ".join(p for _, p in group) + b" ", np.uint8)
        inside = buf != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        n = buf.size
        up, down = (_POW, _POW_INV) if n <= _POW.size else (_powers(_MUL, n), _powers(_INV, n))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[buf] * up[:n], out=sums[1:])
        base, back = sums[starts], down[starts]
        whole.append(mix((sums[ends] - base) * back))
        for k, out in zip(prefixes, heads, strict=True):
            cut = starts + k
            long = cut < ends
            h = mix((sums[np.where(long, cut, ends)] - base) * back + _U(k * 0x51ED2701))
            out.append(np.where(long, h, _U(0)))
        at = np.cumsum([0] + [len(p) + 1 for _, p in group])
        np.add.at(counts, [i for i, _ in group], np.diff(np.searchsorted(starts, at)))
        group.clear()

    size = 0
    for i, piece in _pieces(texts, table):
        group.append((i, piece))
        size += len(piece) + 1
        if size >= CHUNK:
            flush()
            size = 0
    if group:
        flush()
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return join(whole), [join(x) for x in heads], counts


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of all of them where there are fewer, and nothing where there are none."""
    n = words.size
    if not n:
        return words
    width = min(n, k)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * _U(0xD6E8FEB86659FD93) + words[j : n - width + 1 + j]
    return mix(acc)
