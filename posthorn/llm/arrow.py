"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a slice that has more than one row.
SLICE_BYTES = 8 << 20


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``most_bytes`` bytes, or of one row that is larger.

    So Python objects of few texts live at a time, however long the texts are. Spark itself bounds
    the bytes of the batches that it sends (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
