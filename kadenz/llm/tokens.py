"""Ids of texts by byte-pair ranks, for texts of any length, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable

#: Up to so many characters the library splits and merges a text at once; its splitter cannot take white space without end.
AT_ONCE = 50_000
#: Pieces that an encoder of long texts remembers.
REMEMBERED = 100_000


def ordinary(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids. Every match of the pattern is encoded by itself, and no string has a special meaning."""
    import regex
    import tiktoken

    short = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    split, known = regex.compile(pattern), {}

    def encode(text: str) -> list[int]:
        if len(text) <= AT_ONCE:
            return short(text)
        ids: list[int] = []
        for m in split.finditer(text):
            piece = m[0]
            if (found := known.get(piece)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = whole(piece)
                if len(piece) < 100:
                    known[piece] = found
            ids += found
        return ids

    return encode
