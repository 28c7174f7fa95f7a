"""Words of whole texts, as bytes, some of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that are cut into words at once.
PIECE = 1 << 20

# Words are runs of ASCII letters and digits and of all that isn't ASCII; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in order, as lists of the words of some ``size`` bytes each.

    Bytes of characters beyond ASCII are word bytes, so a cut at a separator
    never stands inside a word or a character; a word of more than ``size``
    bytes stays whole.
    """
    low = raw.translate(_TABLE)
    at = 0
    while at < len(low):
        end = low.find(b" ", at + size) if at + size < len(low) else -1
        end = end if end >= 0 else len(low)
        words = low[at:end].split()
        if words:
            yield words
        at = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text of a column in UTF-8; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
