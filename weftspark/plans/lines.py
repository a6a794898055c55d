"""What tasks do with parts of long lines, on sorted Arrow batches.

A real line of even length n is a complex one of h = n / 2 cells, each made of two neighbours.  With h = n1 n2, cell
j = n2 a + b is transformed along a in one task for each b, turned, and along b in one task for each c, which gives
cell k = c + n1 d.  Half spectra are made of cells k and h - k; these have residues c and n1 - c, so both residues are
dealt to one task, and no further exchange is needed.  The way back is the same in the other direction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..errors import TransformError

Columns = list[np.ndarray]

#: Rows that a task gathers before it transforms the groups among them.
AT_ONCE = 1 << 18


def by_groups(keys: int, work: Callable[[Columns], Columns], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands ``work`` whole groups of rows that agree in the first ``keys`` columns, by which the batches are sorted."""

    def made(columns: Columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in work(columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wanted = [], 0, AT_ONCE
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n < wanted:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            before = np.zeros(n, bool)
            for c in whole[:keys]:
                before |= c != c[-1]
            end = int(np.flatnonzero(before)[-1]) + 1 if before.any() else 0
            if end:
                yield made([c[:end] for c in whole])
            held, n = [[c[end:] for c in whole]], n - end
            wanted = AT_ONCE if end else 2 * wanted
        if n:
            yield made([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _turn(k: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * (k % n) / n)


def _dense(ok: bool) -> None:
    if not ok:
        raise TransformError("TransformError: the array isn't dense: a line is incomplete")


def _lines(columns: Columns, keys: int, length: int) -> tuple[Columns, int]:
    """Key columns of lines of equal length whose cells count from 0 in the column after the keys."""
    _dense(len(columns[0]) % length == 0)
    cut = [c.reshape(-1, length) for c in columns[: keys + 1]]
    _dense(all((c == c[:, :1]).all() for c in cut[:keys]) and (cut[keys] == np.arange(length)).all())
    return [c[:, 0] for c in cut[:keys]], len(cut[0])


def _partner(key: Columns, residue: np.ndarray, modulus: int) -> np.ndarray:
    """Of each line the one with the opposite residue: itself or its neighbour."""
    at = np.arange(len(residue))
    own = (2 * residue) % modulus == 0
    other = np.where(own, at, np.where(2 * residue < modulus, at + 1, at - 1))
    _dense(bool(((other >= 0) & (other < len(at))).all()) and (residue[other] == (-residue) % modulus).all() and all((c[other] == c).all() for c in key))
    return other


def pack(columns: Columns, keys: int, n1: int, h: int) -> Columns:
    """keys (the last is b), place (2 a + which of two neighbours), v: transformed along a and turned; to keys, c, re, im."""
    key, lines = _lines(columns, keys, 2 * n1)
    v = columns[-1].reshape(lines, n1, 2)
    z = np.fft.fft(v[..., 0] + 1j * v[..., 1], axis=1) * _turn(key[-1][:, None] * np.arange(n1), h, -1)
    return [*(np.repeat(c, n1) for c in key), np.tile(np.arange(n1), lines), z.real.ravel(), z.imag.ravel()]


def unpack(columns: Columns, keys: int, n1: int, n2: int, sign: int) -> Columns:
    """keys (the last is least(c, n1 - c)), c, b, re, im: transformed along b, and made a half spectrum; to the other keys,
    k, re, im."""
    key, lines = _lines(columns, keys + 1, n2)
    key, c = [*key[: keys - 1], key[-2]], key[-1]
    z = np.fft.fft((columns[-2] + 1j * columns[-1]).reshape(lines, n2), axis=1)
    p = z[_partner(key, c, n1)][:, ::-1]
    p[c == 0] = np.roll(p[c == 0], 1, axis=1)
    p = p.conj()
    k = c[:, None] + n1 * np.arange(n2)
    x = ((z + p) - 1j * _turn(k, 2 * n1 * n2, -1) * (z - p)) / 2
    first = c == 0
    k, x = np.concatenate((k.ravel(), np.full(first.sum(), n1 * n2))), np.concatenate((x.ravel(), z[first, 0].real - z[first, 0].imag + 0j))
    others = [np.concatenate((np.repeat(o, n2), o[first])) for o in key[:-1]]
    return [*others, k, x.real, x.imag if sign < 0 else -x.imag]


def back(columns: Columns, keys: int, n1: int, n2: int, sign: int) -> Columns:
    """keys (the last is least(b, n2 - b)), b, a, re, im of a half spectrum: made complex lines, transformed along a and
    turned; to the other keys, c, b, re, im."""
    b, a = columns[keys], columns[keys + 1]
    x = columns[-2] + 1j * (columns[-1] if sign > 0 else -columns[-1])
    out = []
    for first in (True, False):
        mine = (b == 0) if first else (b > 0)
        if not mine.any():
            continue
        key, lines = _lines([*(c[mine] for c in columns[: keys + 1]), a[mine]], keys + 1, n1 + first)
        key, residue = key[:keys], key[keys]
        z = x[mine].reshape(lines, n1 + first)
        if first:  # cells 0 and h, which are real
            z[:, [0, n1]] = z[:, [0, n1]].real
            z, p = z[:, :n1], z[:, :0:-1].conj()
        else:
            p = z[_partner(key, residue, n2)][:, ::-1].conj()
        k = n2 * np.arange(n1) + residue[:, None]
        z = (z + p) + 1j * _turn(k, 2 * n1 * n2, 1) * (z - p)
        z = np.fft.ifft(z, axis=1, norm="forward") * _turn(residue[:, None] * np.arange(n1), n1 * n2, 1)
        out.append([*(np.repeat(c, n1) for c in key[:-1]), np.tile(np.arange(n1), lines), np.repeat(residue, n1), z.real.ravel(), z.imag.ravel()])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def unfold(columns: Columns, keys: int, n1: int, n2: int) -> Columns:
    """keys (the last is c), b, re, im: transformed along b; to the other keys, place, v of the real line."""
    key, lines = _lines(columns, keys, n2)
    z = np.fft.ifft((columns[-2] + 1j * columns[-1]).reshape(lines, n2), axis=1, norm="forward")
    j = key[-1][:, None] + n1 * np.arange(n2)
    return [*(np.repeat(c, 2 * n2) for c in key[:-1]), np.stack((2 * j, 2 * j + 1), axis=-1).ravel(), np.stack((z.real, z.imag), axis=-1).ravel()]
