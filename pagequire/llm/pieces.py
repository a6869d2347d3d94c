"""SentencePiece encoding and decoding of whole texts with a BPE model, in vectorised merge rounds.

The texts of a batch become one flat array of symbols. It falls into words wherever two characters meet that no piece has
side by side, as no merge can cross such a place; equal words are merged once. A round takes each word's least pair rank by a
segmented minimum, merges the leftmost pairs of that rank in all words at once, and compacts the array; words without
a pair are done. Characters that no piece has become the tokens of their bytes.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters that are merged together; words that are not done after so many rounds go on with a heap.
CHUNK, ROUNDS = 1 << 20, 200
_NEVER = np.int32(np.iinfo(np.int32).max)
_SLOTS = 1 << 19


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need of a model file, a few MB of arrays."""

    size: int
    symbol: np.ndarray  #: of each code point: a piece, `size` and more for one that only pieces of several have, or -1
    alone: np.ndarray  #: code points of symbols from `size` on
    slots: np.ndarray  #: left * width + right of all pairs that make a piece, hashed into slots; -1 in those that are free
    made: np.ndarray  #: of each slot
    rank: np.ndarray
    safe: np.ndarray  #: of each rank: whether merging its leftmost pairs at once is what merging one after another gives
    place: np.ndarray  #: number of each symbol that is a character
    beside: np.ndarray  #: pairs of such numbers that stand side by side in a piece
    width: int
    bytes_: np.ndarray  #: token of each byte
    kind: np.ndarray
    blob: np.ndarray  #: what tokens decode to, one after another
    offset: np.ndarray
    length: np.ndarray

    @cached_property
    def near(self) -> np.ndarray:
        """Whether two characters stand side by side in a piece, by their numbers."""
        n = int(self.place.max(initial=0)) + 1
        out = np.zeros((n, n), bool)
        out[self.beside[:, 0], self.beside[:, 1]] = True
        return out

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether a merge may cross from one symbol, a character, to the next."""
        return self.near[self.place[left], self.place[right]]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "near"}


def load(path: str) -> Model:
    """Read a BPE model with byte fallback that leaves texts as they are but for a blank before them."""
    pieces: list[tuple[str, float, int]] = []
    trainer, normal = {}, {}
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    if (trainer.get(3), trainer.get(35), trainer.get(24, 0)) != (2, 1, 0) or normal.get(2) or (normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)) != (1, 0, 1) or {k for *_, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback, a blank before the text and no other change of it are read")
    size, own = len(pieces), {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
    chars = sorted({c for p in own for c in p})
    ids = dict(own)
    for c in chars:
        ids.setdefault(c, size + len(ids) - len(own))
    alone = [c for c in chars if c not in own]
    width = size + len(alone)
    symbol = np.full(0x110000, -1, np.int32)
    for c in chars:
        symbol[ord(c)] = ids[c]
    level = {s: i for i, s in enumerate(sorted({-s for p, s, k in pieces if k == NORMAL}))}
    rank = {p: level[-pieces[i][1]] for p, i in own.items()}
    pairs: dict[int, tuple[int, int]] = {}
    holders: dict[int, list[str]] = {}
    near: set[tuple[int, int]] = set()
    for p, i in own.items():
        near |= {(ids[a], ids[b]) for a, b in zip(p, p[1:], strict=False)}
        holders.setdefault(rank[p], []).append(p)
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                pairs[ids[p[:k]] * width + ids[p[k:]]] = (i, rank[p])
    safe = np.array([len(holders[r]) == 1 for r in range(len(level))])
    for p, r in rank.items():
        for k in range(1, len(p)):
            for part, other in ((p[:k], p[k:]), (p[k:], p[:k])):
                if other in ids and rank.get(part, -1) >= r:
                    safe[rank[part]] = False
    keys = np.array(sorted(pairs), np.int64)
    slots, made, ranks = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
    for key, at in zip(keys.tolist(), _slot(keys).tolist(), strict=True):
        while slots[at] >= 0:
            at = (at + 1) % _SLOTS
        slots[at], (made[at], ranks[at]) = key, pairs[key]
    place = np.full(width, -1, np.int32)
    place[[ids[c] for c in chars]] = np.arange(len(chars))
    code = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: trainer.get(44, b" \xe2\x81\x87 ")}
    texts = [code[k](p) if k in code else p.replace(SPACE, " ").encode() for p, _, k in pieces]
    length = np.array([len(t) for t in texts], np.int64)
    tokens = np.full(256, -1, np.int32)
    for i, (p, _, k) in enumerate(pieces):
        if k == BYTE:
            tokens[int(p[3:5], 16)] = i
    return Model(
        size, symbol, np.array([ord(c) for c in alone], np.int64), slots, made, ranks, safe, place, np.array([place[list(p)] for p in sorted(near)]).reshape(-1, 2), width, tokens, np.array([k for *_, k in pieces], np.int8), np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length,
    )


def _ranked(m: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, or _NEVER; piece) of pairs of symbols."""
    keys = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * m.width + right)
    at = _slot(keys)
    there = m.slots[at] == keys
    open_ = np.flatnonzero(~there & (m.slots[at] >= 0))
    while open_.size:
        at[open_] = (at[open_] + 1) % _SLOTS
        found = m.slots[at[open_]]
        there[open_] = found == keys[open_]
        open_ = open_[(found >= 0) & ~there[open_]]
    return np.where(there, m.rank[at], _NEVER), m.made[at]


def _heaped(m: Model, word: np.ndarray) -> np.ndarray:
    """A word's pieces by one merge after another, for words of so many merges that rounds would take too long."""
    sym, n = word.tolist(), word.size
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        ranks, made = _ranked(m, np.array([sym[i] for i in lefts], np.int64), np.array([sym[after[i]] for i in lefts], np.int64))
        for i, r, p in zip(lefts, ranks.tolist(), made.tolist(), strict=True):
            if r != _NEVER:
                heapq.heappush(heap, (r, i, sym[i], sym[after[i]], p))

    offer(list(range(n - 1)))
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        if sym[i] != left or after[i] >= n or sym[after[i]] != right:
            continue
        gone = after[i]
        sym[i], sym[gone], after[i] = piece, None, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    return np.array([s for s in sym if s is not None], np.int64)


def merge(m: Model, sym: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, how many each word has) of words, whose symbols are flat in `sym` and begin at `first`."""
    n_words = first.size
    word = np.repeat(np.arange(n_words), np.diff(np.append(first, sym.size)))
    sym, done, owners = sym.astype(np.int64), [], []
    # the last symbol of a word has no pair
    rank, made = np.full(sym.size, _NEVER), np.zeros(sym.size, np.int32)
    if sym.size:
        rank[:-1], made[:-1] = _ranked(m, sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = _NEVER
    for _ in range(rounds):
        if not sym.size:
            break
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(heads, sym.size))
        least = np.minimum.reduceat(rank, heads)
        if (ended := least == _NEVER).any():
            out = np.repeat(ended, sizes)
            done.append(sym[out])
            owners.append(word[out])
            sym, word, rank, made = sym[~out], word[~out], rank[~out], made[~out]
            least, sizes = least[~ended], sizes[~ended]
            if not sym.size:
                break
            heads = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        # of hits in a row every second one is free; where that is not safe, the leftmost of the word is taken alone
        fresh = np.append(True, (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]]))
        at = np.arange(hit.size)
        odd = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 1
        leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])
        hit = hit[np.where(m.safe[rank[hit]], ~odd, leftmost)]
        sym[hit] = made[hit]
        stay = np.ones(sym.size, bool)
        stay[hit + 1] = False
        hit = (np.cumsum(stay) - 1)[hit]
        sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
        near = np.zeros(sym.size, bool)
        near[hit] = near[np.maximum(hit - 1, 0)] = True
        again = np.flatnonzero(near)
        alone = (again + 1 >= sym.size) | (word[np.minimum(again + 1, sym.size - 1)] != word[again])
        rank[again[alone]] = _NEVER
        again = again[~alone]
        rank[again], made[again] = _ranked(m, sym[again], sym[again + 1])
    if sym.size:
        heads = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), sym.size)
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            got = _heaped(m, sym[a:b])
            done.append(got)
            owners.append(np.full(got.size, word[a]))
    flat, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done, owners))
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=n_words)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i] + 1, ... of all stretches one after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_POWERS = np.cumprod(np.append(np.uint64(1), np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64)), dtype=np.uint64)


def _distinct(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of which none is another's copy, for each word which of these it is); words that only share a hash stay apart."""
    sizes = np.diff(np.append(first, sym.size))
    at = np.arange(sym.size) - np.repeat(first, sizes)
    mixed = (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _POWERS[at % _POWERS.size]
    key = np.add.reduceat(mixed, first) * np.uint64(2) + sizes.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    _, kept, of = np.unique(key, return_index=True, return_inverse=True)
    model = kept[of]
    differs = sizes[model] != sizes
    same = np.where(differs, np.arange(first.size), model)
    differs |= np.logical_or.reduceat(sym[np.repeat(first[same], sizes) + at] != sym, first)
    if differs.any():
        of = of.copy()
        of[differs] = kept.size + np.arange(differs.sum())
        kept = np.append(kept, np.flatnonzero(differs))
    return kept, of


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many each) of code points."""
    n = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    of, k = np.repeat(np.arange(codes.size), n), _spread(np.zeros(codes.size, np.int64), n)
    left = (n[of] - 1 - k) * 6
    head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[of]]
    return np.where(k == 0, head | codes[of] >> left, 0x80 | codes[of] >> left & 0x3F), n


def _tokens(m: Model, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, how many each text has) of texts, whose code points are flat in `codes` and begin at `begins`."""
    known = m.symbol[codes]
    sym = np.where(known < 0, -1 - codes.astype(np.int64), known)
    new = np.ones(sym.size, bool)
    inside = (known[1:] >= 0) & (known[:-1] >= 0)
    new[1:][inside] = ~m.joins(known[:-1][inside], known[1:][inside])
    new[begins] = True
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, sym.size))
    kept, of = _distinct(sym, first)
    flat = sym[_spread(first[kept], sizes[kept])]
    pieces, counts = merge(m, flat, np.cumsum(sizes[kept]) - sizes[kept])
    starts = np.cumsum(counts) - counts
    out = pieces[_spread(starts[of], counts[of])]
    text = np.searchsorted(begins, np.repeat(first, counts[of]), "right") - 1
    if (lone := (out < 0) | (out >= m.size)).any():
        points = np.where(out[lone] < 0, -1 - out[lone], m.alone[np.maximum(out[lone] - m.size, 0)] if m.alone.size else 0)
        raw, n = _utf8(points)
        each = np.ones(out.size, np.int64)
        each[lone] = n
        full = np.repeat(out, each)
        full[np.repeat(lone, each)] = m.bytes_[raw]
        out, text = full, np.repeat(text, each)
    return out.astype(np.int32), np.bincount(text, minlength=begins.size)


def _parts(m: Model, text: str, size: int) -> Iterator[str]:
    """A text with a blank before it and blanks as pieces have them, in parts between which no merge goes."""
    text, at = SPACE + text.replace(" ", SPACE), 0
    while len(text) - at > 2 * size:
        end = text.find(SPACE, at + size)
        while end > 0:
            a, b = (int(m.symbol[ord(c)]) for c in text[end - 1 : end + 1])
            if min(a, b) < 0 or not m.joins(a, b):
                break
            end = text.find(SPACE, end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def tokenize(m: Model, texts: Sequence[str | None], chunk: int = CHUNK) -> list[np.ndarray]:
    """Each text's tokens, none for null and empty texts; some `chunk` characters are merged at a time, and one text's parts in turn."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, str]] = []

    def flush() -> None:
        parts = [p.encode("utf-32-le", "surrogatepass") for _, p in group]
        codes = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
        sizes = np.array([len(p) // 4 for p in parts])
        tokens, counts = _tokens(m, codes, np.cumsum(sizes) - sizes)
        for (i, _), part in zip(group, np.split(tokens, np.cumsum(counts)[:-1]), strict=True):
            out[i].append(part)
        group.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in _parts(m, text, chunk) if text else ():
            group.append((i, part))
            size += len(part)
            if size >= chunk:
                flush()
                size = 0
    if group:
        flush()
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def _loose(m: Model, ids: np.ndarray) -> bytes:
    """Tokens whose bytes are not all UTF-8: in each run of byte tokens, what is none becomes U+FFFD byte by byte."""
    out, run = [], bytearray()

    def end() -> None:
        while run:
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[:n]).decode().encode())
                    del run[:n]
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�".encode())
                del run[:1]

    for i in ids.tolist():
        part = m.blob[m.offset[i] : m.offset[i] + m.length[i]].tobytes()
        if m.kind[i] == BYTE:
            run += part
        else:
            end()
            out.append(part)
    end()
    return b"".join(out)


def detokenize(m: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of flat tokens; the blank that encoding puts before a text is taken away."""
    begin = np.cumsum(counts) - counts
    offset, length = m.offset[ids], m.length[ids]
    told = np.flatnonzero(m.kind[ids] != CONTROL)
    text = np.searchsorted(begin, told, "right") - 1 if told.size else told
    # of empty texts and the next one, which begin at the same place, the last is meant
    first = told[np.append(True, text[1:] != text[:-1])] if told.size else told
    first = first[(m.kind[ids[first]] == NORMAL) & (m.blob[np.minimum(m.offset[ids[first]], m.blob.size - 1)] == 32)]
    offset[first] += 1
    length[first] -= 1
    flat = m.blob[_spread(offset, length)].tobytes()
    ends = np.append(0, np.cumsum(length))
    # control tokens end a run of bytes, which may then be no UTF-8
    broken = m.kind[ids] == CONTROL
    out = []
    for a, n in zip(begin.tolist(), counts.tolist(), strict=True):
        raw = flat[ends[a] : ends[a + n]]
        try:
            if broken[a : a + n].any():
                raise UnicodeError
            out.append(raw.decode())
        except UnicodeError:
            whole = _loose(m, ids[a : a + n])
            out.append((whole[1:] if len(first) and np.any((first >= a) & (first < a + n)) else whole).decode())
    return out


def _added(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    columns = [c for c in df.columns if c.lower() != name]
    return columns, T.StructType([*[df.schema[c] for c in columns], T.StructField(name, kind)])


def encode(docs: DataFrame, model: str, rows: int = 500) -> DataFrame:
    """docs(text, ...) with ids, the array of their tokens; no begin or end tokens are added.

    Null and empty texts have none; others are read whole, however long. Every row is encoded on its own, without a
    shuffle; a column named ids is replaced, all others stay, and an empty table gives an empty one. model: path of the
    model file on the driver, from where its tables go to the tasks. rows: rows that are put out together.
    """
    m, (columns, schema) = load(model), _added(docs, "ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                got = tokenize(m, part.column("text").to_pylist())
                ends = np.append(0, np.cumsum([g.size for g in got])).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.concatenate(got) if got else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], ids], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """tokens(ids, ...) with decoded, the text that the ids stand for; null ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD one by one, control tokens nothing. A column named decoded is replaced.
    """
    m, (columns, schema) = load(model), _added(tokens, "decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = part.column("ids")
                counts = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = detokenize(m, flat, counts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(texts, pa.string())], names=schema.names)

    return tokens.mapInArrow(run, schema)
