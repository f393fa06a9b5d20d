"""Words of whole texts as numbers of a dictionary, block by block, for numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

from ._common import _Codes, runs_of

#: Bytes of text that are taken together; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def separators(keep: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z to lower case, ASCII that is not in ``keep`` to blanks, all else as it is."""
    return bytes(b + 32 if 65 <= b <= 90 and b + 32 in keep else b if b in keep or b >= 128 else 32 for b in range(256))


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    return runs_of([len(t or b"") for t in texts], limit)


def numbered_words(texts: list, table: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of the texts (UTF-8, null: none), the words as numbers of that list, and each text's count."""
    lists = [t.translate(table).split() if t else [] for t in texts]
    sizes, codes = np.fromiter(map(len, lists), np.int64, len(lists)), _Codes()
    ids = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    return codes.new, ids, sizes
