"""Values that an expression names more than once, and values of an Arrow batch that Python reads one by one."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: Spark does not share repeated parts inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Values of a batch that are held as Python objects at a time.
SLICE = 128


def in_slices(values: pa.Array, read: Callable, kind: pa.DataType) -> pa.Array:
    """``read`` of each value as one array; Python objects are made for a slice and go before the next, so a batch costs its Arrow data."""
    made = [pa.array([read(x.as_py()) for x in values.slice(at, SLICE)], type=kind) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], type=kind)
