"""What the corpus operators share: Arrow batch sizes and word splitting, beside the package's storage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

from rowmesh.functions.storage import new_folder, written

__all__ = ["free_names", "new_folder", "small", "text_bytes", "word_chunks", "written"]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes, so that long texts can't fill a worker's memory; none without rows.

    Spark itself bounds the bytes of an Arrow batch, whatever its number of rows.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return value.encode("utf-8") if value else b""


#: What parts words; bytes.split() splits on just these six.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for about each `size` bytes, so that one very long text needs little memory."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size and (cut := _SPACE.search(data, at + size)):
            end = cut.start()
        yield data[at:end].split()
        at = end + 1


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, changed where a column has one, in whatever case of letters."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{w}{k or ''}").lower() not in taken) for w in wanted]
