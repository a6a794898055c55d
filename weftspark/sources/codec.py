"""Element codec: little-endian values, bit for bit, and the fixed type codes of the file formats."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import IoError

# Type code, bytes and numpy type of each element type that files can hold.
TYPES = {
    "i8": (1, 1, "<i1"),
    "u8": (2, 1, "<u1"),
    "i16": (3, 2, "<i2"),
    "u16": (4, 2, "<u2"),
    "i32": (5, 4, "<i4"),
    "u32": (6, 4, "<u4"),
    "i64": (7, 8, "<i8"),
    "u64": (8, 8, "<u8"),
    "f32": (9, 4, "<f4"),
    "f64": (10, 8, "<f8"),
    "c64": (11, 8, "<f4"),
    "c128": (12, 16, "<f8"),
}
BY_CODE = {code: name for name, (code, _, _) in TYPES.items()}


@dataclass(frozen=True)
class Scalar:
    """A stored element type."""

    name: str

    def __post_init__(self):
        if self.name not in TYPES:
            raise IoError(f"{self.name} can't be stored")

    @classmethod
    def from_code(cls, code: int, width: int) -> Scalar:
        if code not in BY_CODE or TYPES[BY_CODE[code]][1] != width:
            raise IoError(f"no element type has code {code} and {width} bytes")
        return cls(BY_CODE[code])

    @property
    def code(self) -> int:
        return TYPES[self.name][0]

    @property
    def width(self) -> int:
        return TYPES[self.name][1]

    def encode(self, columns: list[np.ndarray]) -> bytes:
        """Bytes of values; complex ones are given as two columns and stored re, im."""
        kind = np.dtype(TYPES[self.name][2])
        if len(columns) == 1:
            return np.ascontiguousarray(columns[0]).astype(kind, copy=False).tobytes()
        out = np.empty((len(columns[0]), 2), kind)
        out[:, 0], out[:, 1] = columns
        return out.tobytes()

    def decode(self, data: bytes, big_endian: bool = False) -> list[np.ndarray]:
        kind = np.dtype(TYPES[self.name][2]).newbyteorder(">" if big_endian else "<")
        flat = np.frombuffer(data, kind).astype(kind.newbyteorder("="), copy=False)
        return [flat[0::2], flat[1::2]] if self.name.startswith("c") else [flat]
