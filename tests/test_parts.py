"""Python functions hold a bounded part of an Arrow batch as objects."""

import pyarrow as pa

from corpusflow.functions.arrow import PART_BYTES, by_parts


def test_parts_keep_rows_and_bound_them():
    rows = [None, "", "x" * 10_000] * 2_000
    seen = []
    got = by_parts(lambda a, b: seen.append(sum(len(x or "") for x in a)) or [x and y and x + y for x, y in zip(a, b, strict=True)], pa.string(), pa.array(rows), pa.array(rows))
    assert got.to_pylist() == [x and x + x for x in rows]
    assert len(seen) > 5 and max(seen) < PART_BYTES
    assert len(by_parts(lambda a: a, pa.string(), pa.array([], pa.string()))) == 0


def test_pages_become_objects_in_parts():
    """The parser, the chunker and the model's caller see no more of a batch at once."""
    from corpusflow.operators import answer, chunk, html

    assert all(m.by_parts is by_parts for m in (answer, chunk, html))
    seen = []
    by_parts(lambda pages: [seen.append(len(pages)) or html.content(p) for p in pages], html._ARROW, pa.array(["<h1>a &quot</h1><p>" + "b" * 5_000] * 1_500))
    assert len(seen) == 1_500 and max(seen) * 5_000 < PART_BYTES
