"""Arrow UDFs that hold the Python values of a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a batch, as Arrow has them, whose rows are Python values at one time.
SLICE = 4 << 20


def slices(columns: tuple[pa.Array, ...], most: int = SLICE) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in parts of `most` bytes in the mean, of a row at least."""
    n, size = len(columns[0]), max(1, sum(c.nbytes for c in columns))
    rows = max(1, n * most // size)
    for at in range(0, n, rows):
        yield tuple(c.slice(at, rows) for c in columns)


def by_row(returns: T.DataType) -> Callable:
    """Makes a function of one row's values (str, number, array of these, None) a UDF. A batch has up to 10,000 rows, whole texts among them: as Python values all at
    once they take many times their bytes, so only a slice is turned into values, and what comes of it goes into Arrow before the next."""
    kind = to_arrow_type(returns)

    def made(one: Callable) -> Callable:
        def over(*columns: pa.Array) -> pa.Array:
            parts = [pa.array([one(*row) for row in zip(*(c.to_numpy(zero_copy_only=False) for c in part), strict=True)], kind) for part in slices(columns)]
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        return F.arrow_udf(over, returns, F.ArrowUDFType.SCALAR)

    return made
