"""White-space chunks of a text and a bounded memo of what is computed for each."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode's White_Space, which str.split() matches but for four control characters that it also splits at.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_CONTROLS = re.compile("[\\x1c-\\x1f]")
#: Letters and after them ASCII marks, which are words of their own; an apostrophe may be part of a word.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
LIMIT = 600_000


def split_chunks(text: str) -> list[str]:
    """Maximal runs of characters that are not white space."""
    return [x for x in _SPACE.split(text) if x] if _CONTROLS.search(text) else text.split()


class ChunkMemo(dict):
    """What a function gives for each chunk. It starts anew beyond LIMIT entries, so its memory is bounded."""

    def __init__(self, function: Callable):
        super().__init__()
        self.function = function

    def __missing__(self, chunk: str):
        if len(self) >= LIMIT:
            self.clear()
        low, parts = chunk.lower(), None if chunk.isalpha() else _MARKED.fullmatch(chunk)
        if parts and parts[1].isalpha() and parts[1].lower().isalpha():
            value = self[parts[1]] + self[parts[2]]
        elif low != chunk and chunk.isalpha() and low.isalpha() and "Σ" not in chunk:  # the one letter that lower() folds by its place
            value = self[low]
        else:
            value = self.function(chunk)
        self[chunk] = value
        return value
