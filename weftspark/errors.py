"""Errors; all are raised before a Spark job is built unless they concern the data itself.

A query finds out about its data when it runs, and Spark then raises an error of its own, whose text begins with the
name of one of these.  Inside ``typed`` it comes out as that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class ArrayError(ValueError):
    """An array, shape or coordinate that can't be."""


class AxisError(ArrayError):
    """An axis that is out of range or named twice."""


class GeometryError(ArrayError):
    """A partition, range or offset that can't be."""


class ShapeError(ArrayError):
    """Extents that don't fit together."""


class LocalGridError(ArrayError):
    """Coordinate axes that don't fit a layout."""


class TopologyError(ArrayError):
    """A block grid that can't be."""


class LayoutError(ArrayError):
    """A layout that can't be."""


class TransposeError(ArrayError):
    """Layouts between which no single redistribution leads."""


class RemapError(ArrayError):
    """Signs, offsets or layouts of a remap that can't be."""


class PointwiseError(ArrayError):
    """Inputs of a pointwise operation that don't line up."""


class MultiInputError(PointwiseError):
    """As above, for a list of inputs."""


class ReductionError(ArrayError):
    """Inputs of a reduction that don't line up."""


class TransformError(ArrayError):
    """A transform plan or its input that can't be."""


class FftError(TransformError):
    """A complex plan or its input that can't be."""


class R2cError(TransformError):
    """A plan between real arrays and half spectra, or its input, that can't be."""


class R2rError(TransformError):
    """A real-to-real or Hartley plan, or its input, that can't be."""


class MixedError(TransformError):
    """A plan of mixed kinds, or its input, that can't be."""


class OverlapError(TransformError):
    """A plan that offers no overlap."""


class LocalError(TransformError):
    """A local plan, or lines in memory, that can't be."""


class LocalC2cError(LocalError):
    """As above, of complex lines."""


class LocalC2cNdError(LocalError):
    """As above, of blocks of several axes."""


class LocalR2cError(LocalError):
    """As above, of real lines and half spectra."""


class LocalR2rError(LocalError):
    """As above, of real-to-real and Hartley lines."""


class InvalidSpectrum(R2cError, MixedError):
    """A half spectrum that no real array has."""


class WrongState(TransformError):
    """An in-place array that doesn't hold what the operation needs."""


class CollectionError(TransformError):
    """Members of a collection that don't fit together; ``member`` is the first that doesn't."""

    def __init__(self, message: str, member: int | None = None):
        super().__init__(message)
        self.member = member


class IoError(ArrayError):
    """A file that isn't what it should be."""


class NamedIoError(IoError):
    """A container of named arrays, or a name, that isn't what it should be."""


class CollectionIoError(IoError):
    """Members of a stored collection that don't fit together."""


class CatalogError(IoError):
    """A catalog that can't be read."""


@contextmanager
def typed() -> Iterator[None]:
    """Run actions; what a query says about its data is raised as the error that it names."""
    try:
        yield
    except ArrayError:
        raise
    except Exception as e:
        text = str(e)
        for kind in (InvalidSpectrum, ReductionError, TransformError, ShapeError, IoError):
            if (at := text.find(f"{kind.__name__}: ")) >= 0:
                raise kind(text[at + len(kind.__name__) + 2 :].splitlines()[0]) from e
        raise
