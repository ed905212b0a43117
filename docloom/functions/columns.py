"""Arrow arrays as Python values, made column by column: much cheaper than value by value where structs nest."""

from __future__ import annotations

import gc
from contextlib import contextmanager

#: Pages of a batch that are held as Python values at once.
STRETCH = 256


def values(array) -> list:
    """What to_pylist() gives."""
    import pyarrow as pa

    kind = array.type
    if pa.types.is_struct(kind):
        names = [kind.field(k).name for k in range(kind.num_fields)]
        rows = [dict(zip(names, row)) for row in zip(*map(values, array.flatten()))] if names else [{} for _ in range(len(array))]
    elif pa.types.is_list(kind):
        ends = array.offsets.to_pylist()
        inner = values(array.values.slice(ends[0], ends[-1] - ends[0])) if ends else []
        first = ends[0] if ends else 0
        rows = [inner[a - first : b - first] for a, b in zip(ends, ends[1:])]
    elif array.null_count == 0 and (pa.types.is_floating(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_string(kind)):
        return array.to_numpy(zero_copy_only=False).tolist()
    else:
        return array.to_pylist()
    return [r if v else None for r, v in zip(rows, array.is_valid().to_pylist())] if array.null_count else rows


@contextmanager
def unswept():
    """While a stretch of rows is made, Python doesn't search for cycles: rows have none, and are many."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def stretches(batch, size: int = STRETCH):
    """A batch in parts, so that a page's values are Python's only while they are worked on."""
    for k in range(0, batch.num_rows, size):
        yield batch.slice(k, size)


def offsets(sizes: list[int]):
    """Where lists of the sizes begin and end."""
    import numpy as np
    import pyarrow as pa

    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
