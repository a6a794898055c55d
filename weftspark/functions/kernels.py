"""One-axis transforms of numpy arrays, and their normalisation factors.

``forward`` has the negative exponent and no scale, ``backward`` the positive one and no scale; ``inverse`` is backward
divided by the factor of its axes.  Real-to-real kinds, with x of length n:

==========  ==================================================================  =======  ========
kind        Y[k]                                                                reverse  factor
==========  ==================================================================  =======  ========
dct1        x0 + (-1)^k x[n-1] + 2 sum_{1..n-2} x[j] cos(pi j k/(n-1))           dct1     2(n-1)
dct2        2 sum x[j] cos(pi (j+1/2) k/n)                                       dct3     2n
dct3        x0 + 2 sum_{j>=1} x[j] cos(pi j (k+1/2)/n)                           dct2     2n
dct4        2 sum x[j] cos(pi (j+1/2)(k+1/2)/n)                                  dct4     2n
dst1        2 sum x[j] sin(pi (j+1)(k+1)/(n+1))                                  dst1     2(n+1)
dst2        2 sum x[j] sin(pi (j+1/2)(k+1)/n)                                    dst3     2n
dst3        (-1)^k x[n-1] + 2 sum_{j<n-1} x[j] sin(pi (j+1)(k+1/2)/n)            dst2     2n
dst4        2 sum x[j] sin(pi (j+1/2)(k+1/2)/n)                                  dst4     2n
dht         sum x[j] (cos + sin)(2 pi j k/n)                                     dht      n
==========  ==================================================================  =======  ========
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..errors import TransformError

R2R_KINDS = ("dct1", "dct2", "dct3", "dct4", "dst1", "dst2", "dst3", "dst4")
REVERSE = {"dct1": "dct1", "dct2": "dct3", "dct3": "dct2", "dct4": "dct4", "dst1": "dst1", "dst2": "dst3", "dst3": "dst2", "dst4": "dst4", "dht": "dht"}
#: Lines up to this length are transformed by a matrix product, longer ones by an FFT of about the same length (twice it, of real
#: cells, for dct1 and dst1).
MATRIX_LENGTH = 64


def check_length(kind: str, n: int) -> None:
    if n < 1 or (kind == "dct1" and n < 2):
        raise TransformError(f"{kind} needs a longer axis than {n}")


def is_dst(kind: str) -> bool:
    return kind.startswith("dst")


def factor(kind: str, n: int) -> int:
    """What backward(forward(x)) multiplies x by."""
    check_length(kind, n)
    if kind in ("fft", "rfft", "dht"):
        return n
    return {"dct1": 2 * (n - 1), "dst1": 2 * (n + 1)}.get(kind, 2 * n)


def embedding_length(kind: str, n: int) -> int:
    """Length of the symmetric line whose Fourier transform holds that of a real-to-real kind; rounding bounds follow it."""
    check_length(kind, n)
    if kind in ("fft", "rfft", "dht"):
        return n
    return {"dct1": 2 * (n - 1), "dst1": 2 * (n + 1), "dct4": 8 * n, "dst4": 8 * n}.get(kind, 4 * n)


@lru_cache(64)
def basis(kind: str, n: int) -> np.ndarray:
    """The matrix C with Y = C x."""
    j, k = np.arange(n)[None, :], np.arange(n)[:, None]
    if kind == "dct1":
        c = 2 * np.cos(np.pi * ((j * k) % (2 * n - 2)) / (n - 1))
        c[:, 0] /= 2
        c[:, -1] /= 2
        return c
    if kind == "dct2":
        return 2 * np.cos(np.pi * (((2 * j + 1) * k) % (4 * n)) / (2 * n))
    if kind == "dct3":
        c = 2 * np.cos(np.pi * ((j * (2 * k + 1)) % (4 * n)) / (2 * n))
        c[:, 0] /= 2
        return c
    if kind == "dct4":
        return 2 * np.cos(np.pi * (((2 * j + 1) * (2 * k + 1)) % (8 * n)) / (4 * n))
    if kind == "dst1":
        return 2 * np.sin(np.pi * (((j + 1) * (k + 1)) % (2 * n + 2)) / (n + 1))
    if kind == "dst2":
        return 2 * np.sin(np.pi * (((2 * j + 1) * (k + 1)) % (4 * n)) / (2 * n))
    if kind == "dst3":
        c = 2 * np.sin(np.pi * (((j + 1) * (2 * k + 1)) % (4 * n)) / (2 * n))
        c[:, -1] /= 2
        return c
    if kind == "dst4":
        return 2 * np.sin(np.pi * (((2 * j + 1) * (2 * k + 1)) % (8 * n)) / (4 * n))
    raise TransformError(f"no real-to-real kind {kind}")


def _turn(n: int, first: float, by: float) -> np.ndarray:
    """exp(i pi (first + by j)) for j below ``n``."""
    return np.exp(1j * np.pi * (first + by * np.arange(n)))


def _dct2(x: np.ndarray) -> np.ndarray:
    """Cells in the order 0, 2, 4, ..., 5, 3, 1 make the transform one of the same length."""
    n = x.shape[-1]
    v = np.fft.rfft(np.concatenate((x[..., ::2], x[..., 1::2][..., ::-1]), axis=-1))
    v *= _turn(v.shape[-1], 0, -0.5 / n)
    out = np.empty(x.shape)
    out[..., : v.shape[-1]] = 2 * v.real
    # the other half of the spectrum is the conjugate of this one, with a quarter turn more
    rest = n - v.shape[-1]
    out[..., v.shape[-1] :] = -2 * v.imag[..., 1 : rest + 1][..., ::-1]
    return out


def _dct3(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    half = n // 2 + 1
    v = x[..., :half].astype(complex)
    v[..., 1:] -= 1j * x[..., n - 1 : n - half : -1]
    v *= _turn(half, 0, 0.5 / n)
    y = np.fft.irfft(v, n=n, norm="forward")
    out = np.empty(x.shape)
    out[..., ::2], out[..., 1::2] = y[..., : (n + 1) // 2], y[..., (n + 1) // 2 :][..., ::-1]
    return out


def _dct4(x: np.ndarray) -> np.ndarray:
    """The even cells from 0 to 2n - 2 of the result as it goes on beyond n, where it is the odd ones mirrored."""
    n = x.shape[-1]
    v = np.fft.fft(x * _turn(n, 0, -0.5 / n))
    v *= _turn(n, -0.25 / n, -1 / n)
    g, even = 2 * v.real, (n + 1) // 2
    out = np.empty(x.shape)
    out[..., ::2], out[..., 1::2] = g[..., :even], -g[..., even:][..., ::-1]
    return out


def _short(kind: str, x: np.ndarray) -> np.ndarray:
    """A real-to-real transform of real lines along the last axis, by a Fourier transform of about their length."""
    n = x.shape[-1]
    if kind == "dct1":
        return np.fft.rfft(np.concatenate((x, x[..., n - 2 : 0 : -1]), axis=-1)).real
    if kind == "dst1":
        zero = np.zeros((*x.shape[:-1], 1))
        return -np.fft.rfft(np.concatenate((zero, x, zero, -x[..., ::-1]), axis=-1)).imag[..., 1 : n + 1]
    if kind == "dct2":
        return _dct2(x)
    if kind == "dct3":
        return _dct3(x)
    if kind == "dct4":
        return _dct4(x)
    sign = np.where(np.arange(n) % 2, -1.0, 1.0)
    if kind == "dst2":
        return _dct2(x * sign)[..., ::-1]
    return (_dct3 if kind == "dst3" else _dct4)(x[..., ::-1]) * sign


def r2r(kind: str, x: np.ndarray, axis: int) -> np.ndarray:
    """A real-to-real kind; real and imaginary parts of complex input are transformed alike."""
    check_length(kind, x.shape[axis])
    x = np.moveaxis(x, axis, -1)
    if x.shape[-1] <= MATRIX_LENGTH:
        out = x @ basis(kind, x.shape[-1]).T
    elif np.iscomplexobj(x):
        out = np.empty(x.shape, complex)
        out.real, out.imag = _short(kind, x.real), _short(kind, x.imag)
    else:
        out = _short(kind, x)
    return np.moveaxis(out, -1, axis)


def dht(x: np.ndarray, axis: int) -> np.ndarray:
    if x.shape[axis] == 1:
        return x.copy()
    if np.iscomplexobj(x):
        return dht(x.real, axis) + 1j * dht(x.imag, axis)
    f = np.fft.fft(x, axis=axis)
    return f.real - f.imag


def fft(x: np.ndarray, axis: int, sign: int) -> np.ndarray:
    return np.fft.fft(x, axis=axis) if sign < 0 else np.fft.ifft(x, axis=axis, norm="forward")


def rfft(x: np.ndarray, axis: int, sign: int) -> np.ndarray:
    out = np.fft.rfft(x, axis=axis)
    return out if sign < 0 else out.conj()


def crfft(x: np.ndarray, axis: int, n: int, sign: int) -> np.ndarray:
    """Raw complex-to-real; imaginary parts of DC and, if n is even, Nyquist are taken as 0."""
    return np.fft.irfft(x if sign > 0 else x.conj(), n=n, axis=axis, norm="forward")


#: A step is (name, axis, parameter): what a stage does along one axis.
Step = tuple[str, int, int]


def apply(step: Step, x: np.ndarray, axis: int) -> np.ndarray:
    name, _, parameter = step
    if name == "fft":
        return fft(x, axis, parameter)
    if name == "rfft":
        return rfft(x, axis, parameter)
    if name == "crfft":
        return crfft(x, axis, abs(parameter), 1 if parameter > 0 else -1)
    if name == "dht":
        return dht(x, axis)
    return r2r(name, x, axis)
