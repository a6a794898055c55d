"""Word and shingle hashes of whole Arrow batches of texts, in numpy, with no loop over words.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased.  UTF-8 bytes outside ASCII are never separators, so working on
bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial byte hash, its inverse modulo 2**64, and the multipliers of the finalizer (splitmix64).
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U = np.uint64

#: Bytes of text handled at once.
CHUNK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of uint64."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("p", _P), ("i", _INV)):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=_U)
    return _powers["p"], _powers["i"]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: True for the bytes that separate words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What the polynomial hash adds for each byte.
_BYTES = _LOWER.astype(_U) + _U(1)


def parts(texts: pa.Array, space: np.ndarray = SPACE, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """``chunks`` in which a long text is cut at separators into several parts; the last value tells if its text goes on.

    A part ends with a separator and may be longer than ``limit`` only where there is none.
    """
    for first, last, raw, offsets in chunks(texts, limit):
        at = 0
        while last == first + 1 and len(raw) - at > limit:
            near = np.flatnonzero(space[raw[at : at + limit]])
            end = at + int(near[-1]) + 1 if len(near) else 0
            seek = at + limit
            while not end and seek < len(raw):
                near = np.flatnonzero(space[raw[seek : seek + limit]])
                end, seek = (seek + int(near[0]) + 1 if len(near) else 0), seek + limit
            if not end or end >= len(raw):
                break
            yield first, last, raw[at:end], np.array([0, end - at]), True
            at = end
        yield first, last, raw[at:], np.array([0, len(raw) - at]) if at else offsets, False


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, table: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a chunk: first byte, end byte, row and 64-bit hash of each word, in order."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none.astype(_U)
    inside = ~space[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    p, inv = _power(n)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(table[raw] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(_U) * _M2)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row, h


def whole(texts: pa.Array, places: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, and ``words`` of these rows).

    A long text is hashed part after part, so all that grows with it is some 32 bytes a word, or 16 without ``places``:
    then bytes and places of a long text's words are left out.
    """
    held: list[tuple[np.ndarray, ...]] = []
    none = np.zeros(0, np.int64)
    for first, last, raw, offsets, more in parts(texts):
        found = words(raw, offsets)
        if more or held:
            at = sum(len(r) for r, *_ in held)
            held.append((raw, found[0] + at, found[1] + at, *found[2:]) if places else (raw[:0], none, none, *found[2:]))
            if more:
                continue
            yield first, last, *(np.concatenate(c) for c in zip(*held, strict=True))
            held = []
        else:
            yield first, last, raw, *found


def word_counts(texts: pa.Array) -> pa.Array:
    """Number of words of each text."""
    out = np.zeros(len(texts), np.int64)
    for first, last, raw, offsets, _ in parts(texts):
        inside = ~SPACE[raw]
        first_of = inside.copy()
        first_of[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(raw)]
        first_of[cut] = inside[cut]
        run = np.concatenate(([0], np.cumsum(first_of)))
        out[first:last] += run[offsets[1:]] - run[offsets[:-1]]
    return pa.array(out)


def shingles(row: np.ndarray, h: np.ndarray, rows: int, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words; with ``short``, a text with fewer words gives one run of all its words."""
    count = np.bincount(row, minlength=rows)
    if not len(row):
        return row, h
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    out_row, out = [], []
    if len(row) >= k:
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        g = join([h[i : len(h) - k + 1 + i] for i in range(k)])
        out_row.append(row[: len(row) - k + 1][whole])
        out.append(g[whole])
    if short:
        for size in range(1, k):
            if len(few := np.flatnonzero(count == size)):
                out_row.append(few)
                out.append(join([h[first[few] + i] for i in range(size)]))
    if not out:
        return row[:0], h[:0]
    at, g = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(at, kind="stable")
    return at[order], g[order]


def join(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each tuple of hashes."""
    g = np.full(len(parts[0]), len(parts), _U)
    for p in parts:
        g = mix(g * _U(_P) + p)
    return g


def distinct(row: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort and make distinct within each row.  Returns row, hash and the number per row."""
    count = np.bincount(row, minlength=rows)
    g = g.copy()
    at = 0
    for n in count.tolist():
        if n > 1:
            g[at : at + n].sort()
        at += n
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        row, g = row[new], g[new]
    return row, g, np.bincount(row, minlength=rows)
