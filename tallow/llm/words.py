"""Words of UTF-8 text as bytes, by translation tables: no text is decoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text whose words are held as Python objects at once.
SLICE_BYTES = 1 << 20


def _table(word: set[int]) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in word else 32 for b in range(256))


#: A-Z lower-cased; everything but white space makes words.
SPACED = _table(set(range(256)) - set(SPACES))
#: A-Z lower-cased; ASCII letters and digits and all that is not ASCII make words.
ALNUM = _table({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)})


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """Cut translated text at spaces."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    for i in range(len(column)):
        yield bytes(data[offsets[i] : offsets[i + 1]])
