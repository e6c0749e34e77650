"""Arrow batches to Python objects and back, a bounded part at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a batch that are Python objects at once. As objects nested rows take many times their bytes.
PART_BYTES = 2 << 20


def parts(*columns: pa.Array) -> Iterator[list[list]]:
    """Runs of rows of the columns as lists, of about PART_BYTES each."""
    n, size = len(columns[0]), sum(c.nbytes for c in columns)
    step = max(1, n * PART_BYTES // max(size, 1))
    for lo in range(0, n, step):
        yield [c.slice(lo, step).to_pylist() for c in columns]


def by_parts(run: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """run(lists of rows) over the parts of a batch as one array; only one part's objects are alive at a
    time, and what was freed goes back, as workers live on."""
    out = [pa.array(run(*some), kind) for some in parts(*columns)]
    whole = pa.concat_arrays(out) if out else pa.array([], kind)
    del out
    release()
    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
